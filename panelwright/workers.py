"""Ship Python work to executors by module name.

The functions handed to ``mapInPandas``/``mapInArrow``/``applyInPandas`` are closures that carry only a
module path, a function name and plain arguments.  The worker imports the module itself, so module-level
caches live as long as the worker does and the driver never pickles a model or a vocabulary.
"""

from __future__ import annotations

from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[1])


def batches(module: str, name: str, *args, **kwargs):
    """An iterator function for ``mapInPandas``/``mapInArrow``: ``module.name(batches, *args)``."""
    root = ROOT

    def run(source):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        yield from getattr(importlib.import_module(module), name)(source, *args, **kwargs)

    return run


def group(module: str, name: str, *args, **kwargs):
    """A frame function for ``applyInPandas``: ``module.name(frame, *args)``."""
    root = ROOT

    def run(frame):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(frame, *args, **kwargs)

    return run


def cogroup(module: str, name: str, *args, **kwargs):
    """A two-frame function for ``cogroup().applyInPandas``: ``module.name(left, right, *args)``."""
    root = ROOT

    def run(left, right):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.append(root)
        return getattr(importlib.import_module(module), name)(left, right, *args, **kwargs)

    return run
