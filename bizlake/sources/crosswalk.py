"""Crosswalk files: what each column means."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

MEANING = (
    "struct<uri:string,type:string,range:string,domain:string,parent:string,"
    "qualifier:string,qualifier_status:string,note:string>"
)
CROSSWALK_SCHEMA = f"column_name string, semantic {MEANING}"


def parse_crosswalk(documents: DataFrame, section: str | None = None) -> DataFrame:
    """Crosswalk JSON text in ``value`` to rows (column_name, semantic).

    ``section`` picks one table of a file that nests its columns by table.
    Text that is no JSON gives no rows.
    """
    columns = f"map<string,{MEANING}>"
    kind = f"map<string,{columns}>" if section else columns
    walk = F.get_json_object("value", "$._crosswalk")
    mapped = F.from_json(walk, kind)
    if section:
        mapped = F.try_element_at(mapped, F.lit(section))
    return documents.select(F.explode(mapped).alias("column_name", "semantic"))


def load_crosswalk(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """Crosswalk of a file; a missing or broken file gives an empty table."""
    try:
        documents = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], CROSSWALK_SCHEMA)
    return parse_crosswalk(documents, section)
