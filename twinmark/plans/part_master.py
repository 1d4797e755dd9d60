"""The given ``part`` table seen as an item master; the same expressions run in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Column and expression; {string} is the engine's name of the text type.
COLUMNS = (
    ("rec_idx", "p_partkey"),
    ("PART_NO", "concat(upper(replace(p_name, ' ', '-')), '-', cast(p_partkey as {string}))"),
    (
        "DESCRIPTION",
        "concat(p_name, case p_size % 7 when 0 then ' MCB30A' when 1 then ' 10MM x 20' when 2 then ' type 2' when 3 then ' SS pipe 230 V' when 4 then ' filt' when 5 then ' dec coco 1' else '' end)",
    ),
    ("MASTER_PART_DESCRIPTION", "case when p_partkey % 5 = 0 then concat(p_name, ' gen 5 L can 10 Amp') end"),
    ("CONTRACT", "concat('SITE-', cast(p_partkey % 2 as {string}))"),
    ("TYPE_CODE", "p_type"),
    ("PRODUCT_CATEGORY_ID", "case when p_partkey % 11 <> 0 then p_brand end"),
    ("UNIT_MEAS", "case p_size % 3 when 0 then 'PCS' when 1 then 'KG' else 'M' end"),
    ("HSN_SAC_CODE", "nullif(cast(p_size % 5 as {string}), '0')"),
    ("HAZARD_CODE", "nullif(cast(p_partkey % 4 as {string}), '0')"),
)

#: Selected fields of the registered scans.
FIELDS = ["TYPE_CODE", "PRODUCT_CATEGORY_ID"]

#: Descriptions of the assortments: one for each of the twelve places in a lot.  Between them the lots hold every kind of
#: difference that the engines tell apart.
ASSORTMENTS = (
    ("oil filter engine",) * 3 + ("air filter engine",) + ("oil filter engine",) * 8,
    ("filter", "filter", "filters", "filter housing bracket", "spare part", "label", "labels", "oil", "item", "filter oil", "bolt", "filter kit"),
    ("generator bracket long", "vehicle bracket long", "generator bracket", "hvac bracket long", "gen bracket long", "bracket long", "veh bracket longs", "hydraulic bracket", "pneu bracket long", "compressor bracket long", "pump bracket long steel", "elec bracket long"),
    ("paint grade a white", "paint grade b white", "paint red 20 l can", "paint blue 20 l can", "paint red 20 l", "sensor temperature left", "sensor pressure left", "sensor temperature right", "sensor temperature left", "paint white xl", "paint white extra large", "sensor level front"),
    ("mcb 30a", "M.C.B 30 A", "miniature circuit breaker 30a", "mcb 32a", "bolt 10mm", "bolt 10 mm", "bolt 12mm steel", "ss pipe 230 v", "stainless steel pipe 230v", "dec coco 1", "decicated coconut type 1", "desiccated coconut type 2"),
    ("red bicycle small", "red bicycle large", "hydraulic pump seal kit", "hyd pump seal kit", "battery box 12 v", "rubber seal ring 12 x 20", "rubber seal ring 12 x 20 black", "copper cable 3 x 4 x 5", "oil level warning lamp", "fuel level warning lamp", "copper cable", "bat box 12v"),
)
LOT = "cast(floor((p_partkey - 1) / 12) as bigint)"
PLACE = "((p_partkey - 1) % 12)"


def chosen(by: str, values) -> str:
    """The value with the number that an expression gives."""
    return f"case {by} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


#: The same table as lots of twelve records of mixed assortments, sites, units, categories and codes.
MIXED = (
    ("rec_idx", "p_partkey"),
    ("PART_NO", f"case when {PLACE} in (1, 2) then concat('SAME-', cast({LOT} as {{string}})) when {PLACE} = 11 then 'none' when {PLACE} in (0, 5, 6) then concat('PN-HOUSING-', cast(100000 + {LOT} as {{string}}), '-', cast({PLACE} as {{string}})) else concat(upper(substr(p_name, 1, 6)), '-', cast(p_partkey as {{string}})) end"),
    ("DESCRIPTION", "case " + " ".join(f"when {LOT} % {len(ASSORTMENTS)} = {k} then {chosen(PLACE, own)}" for k, own in enumerate(ASSORTMENTS)) + " end"),
    ("MASTER_PART_DESCRIPTION", f"case when {PLACE} in (3, 10) then concat(p_name, ' gen 5 L can') end"),
    ("CONTRACT", f"case {PLACE} when 4 then 'SITE-B' when 5 then ' ' else 'SITE-A' end"),
    ("TYPE_CODE", f"concat('LOT-', cast({LOT} as {{string}}))"),
    ("PRODUCT_CATEGORY_ID", f"case {PLACE} when 8 then 'C2' else 'C1' end"),
    ("UNIT_MEAS", f"case {PLACE} when 9 then 'KG' else 'PCS' end"),
    ("HSN_SAC_CODE", f"case {PLACE} when 10 then '7' when 11 then '8' end"),
    ("HAZARD_CODE", f"case {PLACE} when 6 then 'H2' when 7 then 'H1' end"),
    ("PRIME_COMMODITY", f"case when {PLACE} % 2 = 0 then 'even' when {PLACE} = 7 then '' else 'odd' end"),
)
MIXED_FIELDS = ["TYPE_CODE", "PRIME_COMMODITY"]


def part_master(spark: SparkSession, sf_dir: str, columns=COLUMNS) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(*[f"{e.format(string='string')} as {n}" for n, e in columns])


def duckdb_view(columns=COLUMNS) -> str:
    return "select " + ", ".join(f"{e.format(string='varchar')} as {n}" for n, e in columns) + " from part"
