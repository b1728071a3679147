"""Training-data operators: tokenising, exact / near / substring / line duplicates, decontamination, toxicity, HTML, URLs.

Nothing else in the library imports this subpackage.
"""
