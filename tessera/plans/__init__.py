"""The queries, by topic; importing a module registers what it has."""

from tessera.plans import continuous, corpus, evaluation, lineage, stream, training, verification  # noqa: F401
