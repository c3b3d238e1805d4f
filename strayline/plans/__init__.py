"""The two detectors and the dispatch between them."""
