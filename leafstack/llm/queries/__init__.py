"""All registered queries of this package."""

from . import ctw, jpeg, languages, licenses, merkle, mixing, negatives, packing, sharding, simhash, substrings, topk, warc  # noqa: F401
