"""Named queries: importing the package registers them all."""

from . import asking, contexts, distil, graphs, queries, rules, stewards, streams, walks  # noqa: F401
