"""Sylvan: corpus-scale summary trees, text chunking and node graphs on PySpark.

The names below are loaded when first asked for, so importing the package starts nothing.
"""

from importlib import import_module

__version__ = "0.2.0"

_PLACES = {
    "PipelineConfig": "sylvan.config",
    "build": "sylvan.plans.pipeline",
    "save": "sylvan.plans.pipeline",
    "verifications": "sylvan.plans.pipeline",
    "NodeStore": "sylvan.sources.node_store",
    "Chunker": "sylvan.functions.providers",
    "Clusterer": "sylvan.functions.providers",
    "Summarizer": "sylvan.functions.providers",
    "Verifier": "sylvan.functions.providers",
    "Client": "sylvan.functions.providers",
    "SylvanError": "sylvan.errors",
}
__all__ = ["__version__", *_PLACES]


def __getattr__(name: str) -> object:
    if name in _PLACES:
        return getattr(import_module(_PLACES[name]), name)
    raise AttributeError(name)
