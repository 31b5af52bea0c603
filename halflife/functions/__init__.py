"""Native Column expressions replacing the reference's Python UDFs."""

from halflife.functions.scalars import *  # noqa: F401,F403
