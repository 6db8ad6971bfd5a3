"""Queries over the test tables, each beside its SQL twin."""

from catalog import comparisons, labelling, live, scoring, sequence, splitting, stored, tabular

REGISTRIES = [m.REGISTRY for m in (sequence, labelling, splitting, scoring, tabular, comparisons, live, stored)]
