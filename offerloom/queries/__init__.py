"""The registered queries, by section of the blueprint."""

from . import baskets, files, matching, mutations, plain, scalars, server, windows  # noqa: F401
