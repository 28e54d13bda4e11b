"""Word lists, keyword sets and patterns of the text analysis."""

POSITIVE_WORDS = (
    "growth", "strong", "increased", "improved", "momentum", "expanding", "record", "exceeded", "favorable",
    "opportunity", "confident", "robust", "accelerat",
)
NEGATIVE_WORDS = (
    "decline", "decreased", "headwind", "challenging", "risk", "uncertain", "slowdown", "weakness", "pressure",
    "adverse", "difficult", "impair", "restructur",
)
GUIDANCE_KEYWORDS = (
    "expect", "anticipate", "guidance", "outlook", "forecast", "project", "target", "plan", "believe", "continue",
    "invest", "committed", "remain", "intend", "estimate", "approximately", "range of", "on track",
)
TOPICS = {
    "revenue": ("revenue", "sales", "top line", "top-line", "bookings", "backlog", "order", "volume"),
    "demand": ("demand", "customer", "consumer", "end market", "end-market", "adoption", "penetration"),
    "margins": (
        "margin", "gross profit", "operating income", "cost of goods", "cost of revenue", "profitability",
        "operating expense",
    ),
    "pricing": ("pricing", "price", "average selling price", "asp", "discount"),
    "supply_chain": (
        "supply chain", "supply-chain", "logistics", "inventory", "shortage", "procurement", "supplier", "lead time",
    ),
    "macro": (
        "macroeconomic", "macro", "inflation", "interest rate", "recession", "economic environment", "geopolitical",
        "tariff", "trade", "regulatory",
    ),
    "fx": ("foreign exchange", "currency", "fx", "exchange rate", "foreign currency", "translation"),
    "capex": ("capital expenditure", "capex", "cap ex", "capital spending", "investment in infrastructure"),
    "liquidity": (
        "liquidity", "cash flow", "cash position", "debt", "credit facility", "borrowing", "dividend",
        "share repurchase", "buyback",
    ),
    "products": (
        "product", "launch", "innovation", "pipeline", "r&d", "research and development", "new platform",
        "next generation",
    ),
    "strategy": (
        "strategy", "strategic", "transformation", "restructur", "acquisition", "divestiture", "partnership",
        "joint venture", "long-term", "long term",
    ),
}
FORWARD = (
    "expect", "expects", r"anticipat\w*", "may", "could", "will", "intend", "plan", "believe", "continue to",
    "forecast", "project", "outlook", "guidance", "looking ahead", "going forward", "in the future",
    "over the coming", "in the coming", "likely", "potential",
)
HISTORICAL = (
    "increased", "decreased", "was driven by", "resulted in", "was primarily due", "compared to the prior",
    "compared to the", "year-over-year", "year over year", "quarter-over-quarter", "compared with",
    "during the period", "during the quarter", "during the year", "in the prior", "last year", "last quarter",
    "previously", "declined", "grew",
)
DOLLAR = r"\$\s*[\d,.]+\s*(million|billion|thousand)?"
PERCENT = r"[\d,.]+\s*%"
MATERIAL = ("material", "materially")
SIGNIFICANT = ("significant", "significantly")
CHANGE = ("increase", "decrease")
BOILERPLATE = (
    "forward-looking statements are not guarantees", "actual results may differ",
    "private securities litigation reform act", "safe harbor", "cautionary statement",
)
BLOCK_TAGS = (
    "p", "div", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "section", "article", "header",
    "footer", "table", "thead", "tbody", "tfoot",
)
TICKER_STOP_WORDS = (
    "THE", "AND", "FOR", "ARE", "BUT", "NOT", "YOU", "ALL", "CAN", "HER", "WAS", "ONE", "OUR", "OUT", "HAS", "HIS",
    "HOW", "ITS", "MAY", "NEW", "NOW", "OLD", "SEE", "WAY", "WHO", "DID", "GET", "LET", "SAY", "SHE", "TOO", "USE",
    "CEO", "IPO", "GDP", "FED", "SEC", "ETF", "NYSE", "DOW", "US", "UK", "EU", "AI", "EV", "IT", "IN", "ON", "AT",
    "TO", "UP", "IS", "AS", "IF", "OR", "AN", "SO", "BY", "NO", "DO", "BE", "WE", "OF", "A", "I", "Q1", "Q2", "Q3",
    "Q4", "VS",
)
COMPANY_TICKERS = {
    "apple": "AAPL", "microsoft": "MSFT", "amazon": "AMZN", "nvidia": "NVDA", "google": "GOOGL", "alphabet": "GOOGL",
    "meta": "META", "facebook": "META", "tesla": "TSLA", "berkshire": "BRK-B", "unitedhealth": "UNH",
    "johnson & johnson": "JNJ", "jpmorgan": "JPM", "visa": "V", "procter & gamble": "PG", "exxon": "XOM",
    "home depot": "HD", "mastercard": "MA", "chevron": "CVX", "merck": "MRK", "abbvie": "ABBV", "eli lilly": "LLY",
    "lilly": "LLY", "pepsi": "PEP", "pepsico": "PEP", "coca-cola": "KO", "costco": "COST", "broadcom": "AVGO",
    "walmart": "WMT", "mcdonald": "MCD", "cisco": "CSCO", "accenture": "ACN", "abbott": "ABT", "salesforce": "CRM",
    "thermo fisher": "TMO", "danaher": "DHR", "nike": "NKE", "nextera": "NEE", "linde": "LIN",
    "texas instruments": "TXN", "union pacific": "UNP", "raytheon": "RTX", "honeywell": "HON", "lowe's": "LOW",
    "lowes": "LOW", "amgen": "AMGN", "ibm": "IBM", "intel": "INTC", "qualcomm": "QCOM", "caterpillar": "CAT",
    "boeing": "BA", "goldman sachs": "GS", "goldman": "GS", "american express": "AXP", "blackrock": "BLK",
    "netflix": "NFLX", "amd": "AMD", "advanced micro": "AMD", "palantir": "PLTR", "disney": "DIS", "uber": "UBER",
    "airbnb": "ABNB", "coinbase": "COIN", "robinhood": "HOOD", "gamestop": "GME", "snowflake": "SNOW",
    "spotify": "SPOT",
}
