"""Column functions: null-tolerant predicates, compatible scalars, hashes and parsers."""

from .predicates import OPS, known, negated, predicate
from .scalars import *  # noqa: F403
