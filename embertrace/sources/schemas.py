"""Fixed schemas and tolerant conforming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DoubleType, LongType, ShortType, StringType, StructField, StructType, TimestampNTZType


def _schema(text: str) -> StructType:
    kinds = {"long": LongType(), "double": DoubleType(), "string": StringType(), "boolean": BooleanType(), "ts": TimestampNTZType(), "short": ShortType(), "byte": ByteType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


CHAT = _schema("time:double type:string key:string slot:double player_slot:double match_id:long leagueid:long unit:string")
METADATA = _schema("match_id:long leagueid:long start_date_time:ts duration:long radiant_win:boolean lobby_type:long game_mode:long radiant_team_id:double dire_team_id:double patch:long region:double first_blood_time:double")
PROCESSED = _schema(
    "match_id:long time:double type:string key:string key_lower:string slot:double player_slot:double lang:string lang_source:string match_outcome_for_player:string match_minute:double tier:string leaguename:string "
    "patch_name:string phase:string start_date_time:ts duration:long radiant_win:boolean leagueid:long patch:long region:double lobby_type:long game_mode:long radiant_team_id:double dire_team_id:double "
    "year:short month:byte quarter:byte source_folder:string")  # fmt: skip


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order: missing ones null, values that don't fit null, NaN null, others dropped."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            c = F.lit(None).cast(f.dataType)
        elif df.schema[f.name].dataType == f.dataType:
            c = F.col(f.name)
        elif isinstance(f.dataType, TimestampNTZType) and isinstance(df.schema[f.name].dataType, StringType):
            c = F.try_to_timestamp(F.col(f.name)).cast(f.dataType)
        else:
            c = F.col(f.name).try_cast(f.dataType)
        if isinstance(f.dataType, DoubleType):
            c = F.nanvl(c, F.lit(None).cast("double"))
        out.append(c.alias(f.name))
    return df.select(*out)
