"""Entity / region / year panel analytics on PySpark."""

from isotherm.session import build_session, clear_work, materialize, shared_dir

__all__ = ["build_session", "clear_work", "materialize", "shared_dir"]
