"""Table functions for SQL. ``register(spark)`` makes them known to a session."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from panelmill.functions import kernels as K


@udtf(returnType="unit_ix long, n long, t_stat double, unit_root boolean")
class AdfRow:
    """One row for each series: augmented test of rows (unit_ix, t_ix, value).

    ``SELECT * FROM adf_row(TABLE(SELECT unit_ix, t_ix, y FROM panel) PARTITION BY unit_ix ORDER BY t_ix)``.
    Missing values are left out, positive series tested in logs, short series give 0. A series is one partition.
    """

    def __init__(self):
        self.unit, self.values, self.any = None, [], False

    def eval(self, row) -> None:
        self.unit, self.any = row[0], True
        value = row[2]
        if value is not None and not math.isnan(value):
            self.values.append(float(value))

    def terminate(self) -> Iterator[tuple]:
        if self.any:
            y = np.array(self.values)
            stat = float(K.adf_t(np.log(y) if len(y) and (y > 0).all() else y))
            yield self.unit, len(y), stat, stat > -2.86


def register(spark: SparkSession) -> None:
    spark.udtf.register("adf_row", AdfRow)
