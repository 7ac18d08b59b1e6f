"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from alignlake.plans import alignments, annotations, markup, options, phylogeny, roundtrips, samples, sequences, streams, traces, windows

_MODULES = (alignments, sequences, windows, annotations, phylogeny, traces, options, roundtrips, samples, markup, streams)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
