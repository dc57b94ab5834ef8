"""vitrine: retail analytics operators on Spark DataFrames.

Every operator takes a :class:`~vitrine.sources.tables.RetailTables` bundle (or
plain DataFrames) and returns a lazy DataFrame; Catalyst plans it and Spark runs
it. Nothing is collected to the driver except bounded scalars.
"""

from vitrine.session import build_session, resolve_checkpoint_dir
from vitrine.sources.tables import RetailTables

__all__ = ["RetailTables", "build_session", "resolve_checkpoint_dir"]
