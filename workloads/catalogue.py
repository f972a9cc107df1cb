"""All queries; importing the modules registers them."""

from workloads import columns, filters, joining, reductions, requests, sampling, shaping, streams  # noqa: F401
from workloads.base import QUERIES  # noqa: F401
