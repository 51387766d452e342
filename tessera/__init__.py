"""tessera: knowledge-graph pattern-profile analytics and relation-label
preparation/scoring expressed as Spark DataFrame plans.

Every operator takes DataFrames and returns a lazy DataFrame.  The few
operators that must run an action (dense ordering ids, the subclass
closure loop, ML fits) say so in their docstring.
"""

from tessera.session import build_session, checkpoint_dir, scratch_path

__all__ = ["build_session", "checkpoint_dir", "scratch_path"]
