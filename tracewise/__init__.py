"""tracewise: reasoning-chain analytics expressed as Spark DataFrame jobs.

Every public operator takes DataFrames in the long form described in
``tracewise.schema`` and returns a DataFrame; nothing is collected to the
driver except bounded reports.
"""

from tracewise.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
