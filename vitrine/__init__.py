"""vitrine: marketplace order/review analytics as lazy Spark DataFrame functions.

Every public function takes DataFrames (plus explicit parameters) and returns
a DataFrame; nothing is collected to the driver except bounded scalars at the
edge.  See README.md for the operator map.
"""

from vitrine.params import Params

__all__ = ["Params"]
