"""nameprice: price modelling from short mixed-language product names, on Spark.

Every operator takes and returns a Spark DataFrame (or builds a Column);
nothing row-level passes through the driver.
"""

from nameprice.session import ensure_checkpoint_dir, get_spark

__all__ = ["get_spark", "ensure_checkpoint_dir"]
