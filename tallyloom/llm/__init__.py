"""Training-data operators: token counts, de-duplication, scoring, decontamination, mixing, packing.

Nothing outside this package imports it.
"""
