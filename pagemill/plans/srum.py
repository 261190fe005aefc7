"""Activity records of a system resource usage store, from its tables as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.values import bits_to_double, not_sentinel, oa_date, sid_text, utf16_text, windows_time

#: providers' aliases and GUIDs, system tables, time columns, and the fill of unset time-line values.
PROVIDERS = {
    "network_data": "{973F5D5C-1D90-4944-BE8E-24B94231A174}",
    "network_connectivity": "{DD6636C4-8929-4683-974E-22C046A43763}",
    "energy_estimator": "{DA73FB89-2BEA-4DDC-86B8-6E048C6DA477}",
    "energy_usage": "{FEE4E14F-02A9-4550-B5CE-5FA2DA202E37}",
    "energy_usage_lt": "{FEE4E14F-02A9-4550-B5CE-5FA2DA202E37}LT",
    "application": "{D10CA2FE-6FCF-4F6D-848E-B2E99266FA89}",
    "push_notifications": "{D10CA2FE-6FCF-4F6D-848E-B2E99266FA86}",
    "application_timeline": "{5C8CF1C7-7257-4F13-B223-970EF5939312}",
    "vfu": "{7ACBBAA3-D029-4BE4-9A7A-0885927F1D8F}",
    "sdp_volume_provider": "{17F4D97B-F26A-5E79-3A82-90040A47D13D}",
    "sdp_physical_disk_provider": "{841A7317-3805-518B-C2EA-AD224CB4AF84}",
    "sdp_cpu_provider": "{DC3D3B50-BB90-5066-FA4E-A5F90DD8B677}",
    "sdp_network_provider": "{EEE2F477-0659-5C47-EF03-6D6BEFD441B3}",
    "sdp_perf_count_provider": "{38AD6548-9313-58F8-45C7-D293BAFDC879}",
    "sdp_event_log_provider": "{CDF8EBF6-7C0F-5AC2-158F-DBFBEE981152}",
}
SYSTEM_TABLES = ("MSysObjects", "MSysObjectsShadow", "MSysObjids", "MSysLocales", "SruDbIdMapTable", "SruDbCheckpointTable")
WINDOWS_TIMES = {PROVIDERS["network_connectivity"]: ("ConnectStartTime",), PROVIDERS["application_timeline"]: ("EndTime",)}
SENTINELS = (0x2A2A2A2A2A2A2A2A, 0x2A2A2A2A)


def provider_guid(name: str | None = None, guid: str | None = None) -> str:
    """A provider's GUID by exactly one of its alias and its GUID."""
    if (name is None) == (guid is None):
        raise ValueError("give either a name or a GUID")
    if guid is not None:
        return guid
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider: {name}")
    return PROVIDERS[name]


def id_map(rows: DataFrame, order: str) -> DataFrame:
    """IdIndex and id_text of the id table; the last row of an index in `order` counts (`key` for rows of read_table()).

    An empty blob is null.

    Types 0, 1 and 2 are UTF-16 text, others security identifiers.
    """
    last = rows.groupBy("IdIndex").agg(F.max_by(F.struct("IdType", "IdBlob"), order).alias("r"))
    blob = F.when(F.octet_length("r.IdBlob") > 0, F.col("r.IdBlob"))
    return last.select("IdIndex", F.when(F.col("r.IdType").isin(0, 1, 2), utf16_text(blob)).otherwise(sid_text(blob)).alias("id_text"))


def resolve(entries: DataFrame, ids: DataFrame, columns: tuple[str, ...] = ("AppId", "UserId"), key: str = "IdIndex", value: str = "id_text") -> DataFrame:
    """entries with each id column replaced by its text; unknown ids become null. Spark broadcasts small id tables."""
    for c in columns:
        named = ids.select(F.col(key).alias(f"_{c}"), F.col(value).alias(f"_{c}_text"))
        entries = entries.join(named, entries[c] == named[f"_{c}"], "left").withColumn(c, F.col(f"_{c}_text")).drop(f"_{c}", f"_{c}_text")
    return entries


def unresolved(entries: DataFrame, ids: DataFrame, column: str, key: str = "IdIndex") -> DataFrame:
    """The rows whose id is not in the id table: empty in a sound store."""
    return entries.filter(F.col(column).isNotNull()).join(ids, F.col(column) == F.col(key), "left_anti")


def timed(entries: DataFrame, guid: str) -> DataFrame:
    """A provider's entries with typed times: sentinels become null first, then TimeStamp and ticks are converted."""
    out = entries
    for c, kind in entries.dtypes:
        if kind in ("bigint", "int") and c != "TimeStamp" and guid == PROVIDERS["application_timeline"]:
            out = out.withColumn(c, not_sentinel(F.col(c), *SENTINELS))
    for c in WINDOWS_TIMES.get(guid, ()):
        if c in out.columns:
            out = out.withColumn(c, windows_time(F.col(c)))
    kind = dict(out.dtypes).get("TimeStamp")
    if kind in ("double", "bigint"):  # days, or the stored bits of them
        out = out.withColumn("TimeStamp", oa_date(F.col("TimeStamp") if kind == "double" else bits_to_double(F.col("TimeStamp"))))
    return out


def entries(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All rows of all tables that aren't the system's, with their provider; missing columns are null.

    Without such a table there is no schema to give, which is a ValueError.
    """
    own = [df.withColumn("provider", F.lit(name)) for name, df in tables.items() if name not in SYSTEM_TABLES]
    if not own:
        raise ValueError("no table of a provider")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)
