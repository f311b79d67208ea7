from rarefold.functions.rng import normal, uniform, sql_uniform, sql_normal  # noqa: F401
from rarefold.functions.prefix import running_totals, global_row_number  # noqa: F401
