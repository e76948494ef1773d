"""Every query of the library outside the training-data operators, bound to the test tables."""

from __future__ import annotations

from probity.plans import assurance, corpus, evidence, reporting

QUERIES: dict = {**corpus.QUERIES, **evidence.QUERIES, **reporting.QUERIES, **assurance.QUERIES}
ORACLE: dict[str, str] = {**corpus.ORACLE, **evidence.ORACLE, **reporting.ORACLE, **assurance.ORACLE}
