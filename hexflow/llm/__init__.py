"""Training-data operators: deduplication, decontamination, mixing, extraction, scoring and output.

The rest of the library never imports this subpackage; removing it leaves everything else working.
"""
