"""The tables that operators keep between their steps; see :mod:`braid.tables`."""

from ..tables import finished, fresh_names, fresh_path, release, shared_dir, written

__all__ = ["finished", "fresh_names", "fresh_path", "release", "shared_dir", "written"]
