"""The corpus pipeline as a registered query."""

from __future__ import annotations

import corpus_pipeline


def queries():
    return {"pipeline": corpus_pipeline.run}
