"""All queries of the corpus operators and their SQL."""

from listwright.llm import byte_bpe, decontamination, exact_dedup, importance, language, line_dedup, near_dedup, packing, pii, sharding, url_filter, warc, whitening  # noqa: F401
from listwright.llm.common import ORACLES, QUERIES  # noqa: F401
