"""The operators as SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .codec import grid
from .codec.faults import Fault
from .operators.decode import IMAGE, _fault, _image


def register(spark: SparkSession) -> None:
    """gridwave_decode(binary) -> struct of an image, and the data source grib2_jpeg."""

    @F.pandas_udf("struct<" + IMAGE.replace("error struct", "error:struct").replace(" int", ":int").replace(" boolean", ":boolean").replace(" array", ":array") + ">")
    def decoded(data):
        import pandas as pd

        rows = []
        for x in data:
            try:
                if x is None:
                    raise Fault("Codestream", "no bytes")
                rows.append(_image(*grid.decode(bytes(x))))
            except Exception as e:
                rows.append((None, None, None, None, None, _fault(e)))
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(("width", "height", "bit_depth", "signed", "samples", "error"), zip(*rows))})

    spark.udf.register("gridwave_decode", decoded)
    from .sources import grib2

    grib2.register(spark)
