"""All operators of the subpackage; importing this registers their queries."""

from gleanery.llm import alignment, boilerplate, debruijn, decontaminate, mtree, negatives, pieces, setsketch, sharding, simhash, suffixes, toxicity, urls  # noqa: F401
