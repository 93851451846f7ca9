"""Training-data operators: de-duplication, filtering, scanning, counting and packing of documents.

Nothing outside this subpackage imports it.
"""
