"""clausegrid: contract and document analytics as PySpark DataFrame operators."""

from clausegrid.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
