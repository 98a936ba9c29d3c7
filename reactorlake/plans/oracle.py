"""DuckDB SQL twins of the registered queries (same columns, same values).

The outage tables are rebuilt from ``lineitem`` and ``supplier`` with the
adapter's exact rules in a shared ``WITH`` prefix; every query body is then
plain SQL over them. Parameters are the registry's fixed values.
"""

from __future__ import annotations

from reactorlake.plans import registry as Q

_DAY = "'%Y-%m-%d'"


def _d(expr: str) -> str:
    return f"strftime({expr}, {_DAY})"


_BASE = """
facility_outages AS (
  SELECT date, facility_id, capacity, outage, outage * 100.0 / capacity AS percent_outage
  FROM (
    SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS facility_id,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS capacity,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS outage
    FROM lineitem GROUP BY 1, 2) t),
us_outages AS (
  SELECT date, capacity, outage, outage * 100.0 / capacity AS percent_outage
  FROM (
    SELECT CAST(l_shipdate AS DATE) AS date,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS capacity,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS outage
    FROM lineitem GROUP BY 1) t),
plants AS (SELECT CAST(s_suppkey AS VARCHAR) AS facility_id, s_name AS facility_name FROM supplier),
reduced_plants AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS facility_id, s_name AS facility_name FROM supplier WHERE s_acctbal >= 0),
raw_fac AS (
  SELECT f.date, f.facility_id, f.capacity, f.outage, f.percent_outage,
         CASE WHEN dayofyear(f.date) % 97 = 0 THEN ''
              WHEN dayofyear(f.date) % 89 = 0 THEN NULL
              ELSE p.facility_name END AS name,
         dayofyear(f.date) % 83 = 0 AS bad_cap
  FROM facility_outages f LEFT JOIN plants p ON p.facility_id = f.facility_id),
valid_fac AS (
  SELECT date, facility_id, name AS facility_name,
         CASE WHEN bad_cap THEN NULL ELSE capacity END AS capacity, outage, percent_outage
  FROM raw_fac WHERE name IS NOT NULL AND name <> ''),
fac_recent AS (
  SELECT * FROM facility_outages WHERE date >= (SELECT MAX(date) FROM facility_outages) - 30),
fac_inc AS (
  SELECT date, facility_id, capacity, outage * 2.0 AS outage, outage * 2.0 * 100.0 / capacity AS percent_outage
  FROM fac_recent
  UNION ALL
  SELECT date + 31, facility_id, capacity, outage, percent_outage FROM fac_recent),
us_recent AS (
  SELECT * FROM us_outages WHERE date >= (SELECT MAX(date) FROM us_outages) - 30),
us_inc AS (
  SELECT date, capacity, outage * 2.0 AS outage, outage * 2.0 * 100.0 / capacity AS percent_outage FROM us_recent
  UNION ALL
  SELECT date + 31, capacity, outage, percent_outage FROM us_recent)
"""


def _q(body: str, extra: str = "") -> str:
    return "WITH " + _BASE + (", " + extra if extra else "") + "\n" + body


def _facts(where: str = "", table: str = "facility_outages") -> str:
    w = f" WHERE {where}" if where else ""
    return _q(f"SELECT {_d('date')} AS date, facility_id, capacity, outage, percent_outage FROM {table}{w}")


def _us(where: str = "", table: str = "us_outages") -> str:
    w = f" WHERE {where}" if where else ""
    return _q(f"SELECT {_d('date')} AS date, capacity, outage, percent_outage FROM {table}{w}")


def _page_facility(where: str, offset: int, limit: int) -> str:
    w = f" WHERE {where}" if where else ""
    return _q(
        f"""SELECT {_d('f.date')} AS date, f.facility_id, f.capacity, f.outage, f.percent_outage,
                   p.facility_name, CAST(f.rn - 1 - {offset} AS BIGINT) AS page_rank
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id ASC) AS rn
                  FROM facility_outages{w}) f
            LEFT JOIN plants p ON p.facility_id = f.facility_id
            WHERE f.rn > {offset} AND f.rn <= {offset + limit}"""
    )


def _upsert(base: str, batch: str, keys: list[str], cols: str) -> str:
    cond = " AND ".join(f"b.{k} = t.{k}" for k in keys)
    return f"""SELECT {cols} FROM (
                 SELECT * FROM {base} t WHERE NOT EXISTS (SELECT 1 FROM {batch} b WHERE {cond})
                 UNION ALL SELECT * FROM {batch})"""


_FACT_OUT = f"{_d('date')} AS date, facility_id, capacity, outage, percent_outage"
_US_OUT = f"{_d('date')} AS date, capacity, outage, percent_outage"
_VALID = "name IS NOT NULL AND name <> ''"

# Picked ids known to the dimension, in its order. SQL cannot derive pivot
# columns from data, so this list is fixed: supplier keys are 0..99 at sf0.01
# (0..999 at sf0.1), so all four exist there. At sf0.001 (keys 0..9) the Spark
# query rightly has no column "10" and this twin does not apply.
_CHART_IDS = ["1", "10", "3", "7"]
_PICK = ", ".join(f"'{i}'" for i in Q.SERIES_PICK[: Q.CHART_SERIES])
_ALL_PICKED = ", ".join(f"'{i}'" for i in Q.SERIES_PICK)
# all picked ids of the dimension, in its order (see above)
_MANY_IDS = ["1", "10", "2", "3", "5", "7"]


def _aligned(include_us: bool) -> str:
    lo, hi = Q.CHART_FROM, Q.CHART_TO
    us_cte = f"""us_s AS (SELECT date, 'us' AS series, outage FROM us_outages
                           WHERE date BETWEEN DATE '{lo}' AND DATE '{hi}' ORDER BY date DESC LIMIT 60)"""
    fac_cte = f"""fac_s AS (SELECT date, facility_id AS series, outage FROM (
                    SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY date DESC) AS rk
                    FROM facility_outages
                    WHERE date BETWEEN DATE '{lo}' AND DATE '{hi}'
                      AND facility_id IN (SELECT facility_id FROM plants WHERE facility_id IN ({_PICK}))) x
                  WHERE rk <= 60)"""
    union = "SELECT * FROM fac_s" + (" UNION ALL SELECT * FROM us_s" if include_us else "")
    cols = ([("us", "us")] if include_us else []) + [(i, i) for i in _CHART_IDS]
    pivots = ", ".join(f"MAX(CASE WHEN series = '{v}' THEN outage END) AS \"{n}\"" for v, n in cols)
    return _q(
        f"""SELECT {_d('date')} AS date, {pivots}, CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS date_rank
            FROM ({union}) l GROUP BY date""",
        fac_cte + (", " + us_cte if include_us else ""),
    )


def _limit_expr(a: str, b: str) -> str:
    return (
        f"CAST(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 250 WHEN {b} - {a} + 1 <= 0 THEN 250 "
        f"ELSE LEAST({b} - {a} + 1, 60, 1000) END AS BIGINT)"
    )


_MW = r"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '') || ' MW'"


def _labels(src: str, with_name: bool) -> str:
    name = "facility_name, " if with_name else ""
    return (
        f"SELECT {_d('date')} AS date, {name}{_MW.format(c='capacity')} AS capacity, "
        f"{_MW.format(c='outage')} AS outage, printf('%.2f%%', percent_outage) AS percent_outage FROM {src}"
    )


_INC_RAW = """raw_inc AS (
  SELECT i.date, i.facility_id, i.capacity, i.outage, i.percent_outage,
         CASE WHEN dayofyear(i.date) % 97 = 0 THEN ''
              WHEN dayofyear(i.date) % 89 = 0 THEN NULL
              ELSE p.facility_name END AS name,
         dayofyear(i.date) % 83 = 0 AS bad_cap
  FROM fac_inc i LEFT JOIN plants p ON p.facility_id = i.facility_id),
valid_inc AS (
  SELECT date, facility_id, CASE WHEN bad_cap THEN NULL ELSE capacity END AS capacity, outage, percent_outage
  FROM raw_inc WHERE name IS NOT NULL AND name <> ''),
valid_base AS (SELECT date, facility_id, capacity, outage, percent_outage FROM valid_fac)"""

# what a run reads of the increment: from the newest loaded date on
_LATE = """,
late_inc AS (SELECT * FROM valid_inc WHERE date >= (SELECT MAX(date) FROM valid_fac))"""


SQL: dict[str, str] = {
    "scan_facility": _facts(),
    "scan_us": _us(),
    "scan_plants": _q("SELECT facility_id, facility_name FROM plants"),
    "filter_date_from": _facts(f"date >= DATE '{Q.LATE_FROM}'"),
    "filter_date_to": _facts(f"date <= DATE '{Q.EARLY_TO}'"),
    "filter_date_range": _us(f"date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}'"),
    "filter_facility": _facts(f"facility_id = '{Q.FACILITY}'"),
    "filter_map": _facts(f"date BETWEEN DATE '{Q.MAP_FROM}' AND DATE '{Q.MAP_TO}' AND facility_id = '{Q.MAP_FACILITY}'"),
    "page_facility": _page_facility(
        f"date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}'", Q.PAGE_OFFSET, Q.PAGE_LIMIT
    ),
    "page_us": _q(
        f"""SELECT {_d('date')} AS date, capacity, outage, percent_outage, CAST(rn - 1 AS BIGINT) AS page_rank
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM us_outages) u WHERE rn <= 100"""
    ),
    "page_plants": _q(
        f"""SELECT facility_id, facility_name, CAST(rn - 1 - {Q.PLANTS_OFFSET} AS BIGINT) AS page_rank
            FROM (SELECT *, row_number() OVER (ORDER BY facility_id) AS rn FROM plants) p
            WHERE rn > {Q.PLANTS_OFFSET} AND rn <= {Q.PLANTS_OFFSET + Q.PLANTS_LIMIT}"""
    ),
    "page_deep": _q(
        f"""SELECT {_d('f.date')} AS date, f.facility_id, f.capacity, f.outage, f.percent_outage,
                   p.facility_name, CAST(f.rn - 1 - f.off AS BIGINT) AS page_rank
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id ASC) AS rn,
                         CAST(floor(COUNT(*) OVER () * {Q.DEEP_SHARE}::DOUBLE) AS BIGINT) AS off FROM facility_outages) f
            LEFT JOIN plants p ON p.facility_id = f.facility_id
            WHERE f.rn > f.off AND f.rn <= f.off + {Q.DEEP_LIMIT}"""
    ),
    "page_clamped": _q(
        """SELECT CAST(COUNT(*) AS BIGINT) AS total_count, CAST(0 AS BIGINT) AS "offset", CAST(1000 AS BIGINT) AS "limit",
                  CAST(LEAST(COUNT(*), 1000) AS BIGINT) AS returned,
                  CASE WHEN 1000 < COUNT(*) THEN CAST(1000 AS BIGINT) END AS next_offset, TRUE AS limit_clamped
           FROM facility_outages"""
    ),
    "page_rest": _q(
        f"""SELECT {_d('date')} AS date, capacity, outage, percent_outage
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn FROM us_outages) u WHERE rn > {Q.META_OFFSET}"""
    ),
    "page_arguments": _q(
        """SELECT facility_id, dataset, CASE WHEN dataset = 'other' THEN 'dataset' WHEN turn = 1 THEN 'date_from' WHEN turn = 2 THEN 'range'
                  WHEN turn <> 3 AND dataset <> 'facility' THEN 'facility_id' END AS fault
           FROM (SELECT facility_id, CAST(facility_id AS BIGINT) % 4 AS turn, unnest(['facility', 'us', 'plants', 'other']) AS dataset FROM plants) p"""
    ),
    "page_without_names": _q(
        f"""SELECT {_d('date')} AS date, facility_id, capacity, outage, percent_outage,
                   CAST(rn - 1 - {Q.PAGE_OFFSET} AS BIGINT) AS page_rank
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id ASC) AS rn FROM facility_outages
                  WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}') f
            WHERE rn > {Q.PAGE_OFFSET} AND rn <= {Q.PAGE_OFFSET + Q.PAGE_LIMIT}"""
    ),
    "stored_facility": _q(
        f"""SELECT {_d('date')} AS date, facility_id, capacity, outage, percent_outage,
                   CAST(row_number() OVER (ORDER BY date DESC) - 1 AS BIGINT) AS page_rank
            FROM facility_outages WHERE facility_id = '{Q.FACILITY}'
              AND date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}' ORDER BY date DESC LIMIT 100"""
    ),
    "page_metadata": _q(
        f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_count, CAST({Q.META_OFFSET} AS BIGINT) AS "offset",
                   CAST({Q.META_LIMIT} AS BIGINT) AS "limit",
                   CAST(LEAST(GREATEST(COUNT(*) - {Q.META_OFFSET}, 0), {Q.META_LIMIT}) AS BIGINT) AS returned,
                   CASE WHEN {Q.META_OFFSET + Q.META_LIMIT} < COUNT(*)
                        THEN CAST({Q.META_OFFSET + Q.META_LIMIT} AS BIGINT) END AS next_offset, FALSE AS limit_clamped
            FROM facility_outages WHERE facility_id = '{Q.FACILITY}' AND date >= DATE '{Q.DATE_FROM}'"""
    ),
    "page_keyset": _q(
        f"""SELECT {_d('date')} AS date, facility_id, capacity, outage, percent_outage,
                   CAST(row_number() OVER (ORDER BY date DESC, facility_id) - 1 AS BIGINT) AS page_rank
            FROM (SELECT * FROM facility_outages
                  WHERE date < DATE '{Q.KEYSET_DATE}'
                     OR (date = DATE '{Q.KEYSET_DATE}' AND facility_id > '{Q.KEYSET_FACILITY}')
                  ORDER BY date DESC, facility_id LIMIT {Q.KEYSET_LIMIT}) k"""
    ),
    "page_plan": _q(
        """SELECT CAST(g AS BIGINT) AS page_no, CAST(g * 5000 AS BIGINT) AS "offset",
                  CAST(LEAST(5000, GREATEST(total - g * 5000, 0)) AS BIGINT) AS length
           FROM (SELECT total, unnest(generate_series(0, GREATEST(CAST(ceil(total / 5000.0) AS BIGINT), 1) - 1)) AS g
                 FROM (SELECT COUNT(*) AS total FROM raw_fac) t) s"""
    ),
    "page_numbers": _q(
        f"""SELECT {_d('date')} AS date, facility_id, CAST(rn AS BIGINT) AS row_idx,
                   CAST(rn // {Q.NUMBER_PAGE} AS BIGINT) AS page_no, CAST(rn % {Q.NUMBER_PAGE} AS BIGINT) AS page_pos
            FROM (SELECT date, facility_id, row_number() OVER (ORDER BY date DESC, facility_id) - 1 AS rn
                  FROM facility_outages) n"""
    ),
    "page_walk": _q(
        f"""SELECT {_d('f.date')} AS date, f.facility_id, f.capacity, f.outage, f.percent_outage, p.facility_name,
                   CAST(f.rn AS BIGINT) AS row_idx, CAST(f.rn // {Q.PAGE_LIMIT} AS BIGINT) AS page_no,
                   CAST(f.rn % {Q.PAGE_LIMIT} AS BIGINT) AS page_pos
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id) - 1 AS rn FROM facility_outages
                  WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}') f
            LEFT JOIN plants p ON p.facility_id = f.facility_id"""
    ),
    "page_records": _q(
        f"""SELECT CAST(f.rn - 1 AS BIGINT) AS page_rank,
                   CAST(json_object('facility_id', f.facility_id, 'date', {_d('f.date')}, 'capacity',
                               CASE WHEN day(f.date) % 2 = 0 THEN f.capacity END,
                               'outage', f.outage, 'percent_outage', f.percent_outage,
                               'facility_name', p.facility_name) AS VARCHAR) AS record
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id) AS rn
                  FROM facility_outages WHERE facility_id = '{Q.FACILITY}') f
            LEFT JOIN plants p ON p.facility_id = f.facility_id WHERE f.rn <= 25"""
    ),
    "facility_with_names": _q(
        f"""SELECT {_d('f.date')} AS date, f.facility_id, f.capacity, f.outage, f.percent_outage, p.facility_name
            FROM facility_outages f LEFT JOIN plants p ON p.facility_id = f.facility_id"""
    ),
    "facility_unknown_names": _q(
        f"""SELECT {_d('f.date')} AS date, f.facility_id, f.capacity, f.outage, f.percent_outage, p.facility_name
            FROM facility_outages f LEFT JOIN reduced_plants p ON p.facility_id = f.facility_id"""
    ),
    "name_lookup": _q(
        """SELECT d.facility_id, p.facility_name
           FROM (SELECT DISTINCT facility_id FROM facility_outages) d
           LEFT JOIN reduced_plants p ON p.facility_id = d.facility_id"""
    ),
    "overview_all": _q(
        f"""SELECT 'facility' AS dataset, {_d('f.date')} AS date, f.facility_id, p.facility_name, f.capacity, f.outage,
                   f.percent_outage, CAST(f.rn - 1 AS BIGINT) AS page_rank, f.total_count
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id) AS rn, COUNT(*) OVER () AS total_count
                  FROM facility_outages WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}') f
            LEFT JOIN plants p ON p.facility_id = f.facility_id
            WHERE f.rn <= {Q.OVERVIEW_LIMIT}
            UNION ALL
            SELECT 'us', {_d('date')}, NULL, NULL, capacity, outage, percent_outage, CAST(rn - 1 AS BIGINT), total_count
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC) AS rn, COUNT(*) OVER () AS total_count
                  FROM us_outages WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}') u
            WHERE rn <= {Q.OVERVIEW_LIMIT}
            UNION ALL
            SELECT 'plants', NULL, facility_id, facility_name, NULL, NULL, NULL, CAST(rn - 1 AS BIGINT), total_count
            FROM (SELECT *, row_number() OVER (ORDER BY facility_id) AS rn, COUNT(*) OVER () AS total_count
                  FROM plants) pl
            WHERE rn <= {Q.OVERVIEW_LIMIT}"""
    ),
    "series_latest_n": _q(
        f"""SELECT r.facility_id, p.facility_name, {_d('r.date')} AS date, r.outage, CAST(r.rk AS BIGINT) AS series_rank
            FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY date DESC) AS rk
                  FROM facility_outages WHERE date <= DATE '{Q.SERIES_TO}' AND facility_id IN ({_PICK})) r
            JOIN plants p ON p.facility_id = r.facility_id
            WHERE r.rk <= 250"""
    ),
    "series_aligned": _aligned(True),
    "series_without_us": _aligned(False),
    "clamp_range": _q(
        f"""SELECT facility_id, CAST(year AS BIGINT) AS year, {_d('a')} AS range_from, {_d('b')} AS range_to,
                   {_d('LEAST(GREATEST(COALESCE(b, a), a), a + 59)')} AS to_after_from_edit,
                   {_d('GREATEST(LEAST(COALESCE(a, b), b), b - 59)')} AS from_after_to_edit,
                   CAST(COALESCE(b - a + 1, 0) AS BIGINT) AS day_count,
                   {_limit_expr('a', 'b')} AS series_limit,
                   {_limit_expr('b', 'a')} AS reversed_limit,
                   {_d('b - 30')} AS default_from,
                   {_d('LEAST(a + 45, b)')} AS earlier_end
            FROM (SELECT facility_id, year, CASE WHEN turn = 1 THEN hi ELSE lo END AS a,
                         CASE WHEN turn = 1 THEN lo WHEN turn = 0 THEN hi END AS b
                  FROM (SELECT facility_id, year(date) AS year, MIN(date) AS lo, MAX(date) AS hi,
                               (year(date) + CAST(facility_id AS BIGINT)) % 3 AS turn
                        FROM facility_outages GROUP BY facility_id, year(date)) r) s"""
    ),
    "display_us": _q(_labels("us_outages", False)),
    "display_facility": _q(
        _labels("(SELECT f.*, p.facility_name FROM facility_outages f LEFT JOIN plants p "
                "ON p.facility_id = f.facility_id) j", True)
    ),
    "validate_required": _q(
        f"""SELECT {_d('date')} AS period, facility_id AS facility, name AS "facilityName" FROM raw_fac WHERE {_VALID}"""
    ),
    "validate_report": _q(
        f"""SELECT {_d('date')} AS period, facility_id AS facility, 'facilityName' AS missing_fields
            FROM raw_fac WHERE NOT ({_VALID}) OR name IS NULL"""
    ),
    "validate_counts": _q(
        f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_records,
                   CAST(COUNT(*) FILTER (WHERE {_VALID}) AS BIGINT) AS valid_records, 'facility' AS dataset FROM raw_fac
            UNION ALL
            SELECT CAST(COUNT(*) AS BIGINT), CAST(COUNT(*) FILTER (WHERE dayofyear(date) % 89 <> 0) AS BIGINT), 'us'
            FROM us_outages"""
    ),
    "coerce_numeric": _q(
        f"""SELECT {_d('date')} AS period, facility_id AS facility,
                   CASE WHEN bad_cap THEN NULL ELSE capacity END AS capacity, outage, percent_outage FROM raw_fac"""
    ),
    "transform_facility": _q(
        f"SELECT {_d('date')} AS date, facility_id, facility_name, capacity, outage, percent_outage FROM valid_fac"
    ),
    "transform_us": _q(
        f"""SELECT {_d('date')} AS date, CASE WHEN dayofyear(date) % 83 = 0 THEN NULL ELSE capacity END AS capacity,
                   outage, percent_outage FROM us_outages WHERE dayofyear(date) % 89 <> 0"""
    ),
    "distinct_plants": _q("SELECT DISTINCT facility_id, facility_name FROM valid_fac"),
    "watermark": _q(
        f"""SELECT {_d('MAX(date)')} AS last_extraction_date, 'facility_outages' AS dataset FROM facility_outages
            UNION ALL SELECT {_d('MAX(date)')}, 'us_outages' FROM us_outages
            UNION ALL SELECT {_d('MAX(date)')}, 'plants' FROM facility_outages"""
    ),
    "watermark_advance": _q(
        f"""SELECT 'facility_outages' AS dataset, {_d('m - 30')} AS stored, {_d('m + 31')} AS batch_max,
                   {_d('GREATEST(m - 30, m + 31)')} AS advanced
            FROM (SELECT MAX(date) AS m FROM facility_outages) a
            UNION ALL
            SELECT 'us_outages', {_d('m - 30')}, NULL, {_d('m - 30')} FROM (SELECT MAX(date) AS m FROM us_outages) b"""
    ),
    "incremental_rows": _q(
        f"""SELECT {_d('date')} AS period, facility_id AS facility, name AS "facilityName" FROM raw_fac
            WHERE date >= (SELECT MAX(date) FROM facility_outages) - 30"""
    ),
    "upsert_facility": _q(_upsert("facility_outages", "fac_inc", ["date", "facility_id"], _FACT_OUT)),
    "upsert_us": _q(_upsert("us_outages", "us_inc", ["date"], _US_OUT)),
    "upsert_plants": _q(
        _upsert("old_plants", "new_plants", ["facility_id"], "facility_id, facility_name"),
        """old_plants AS (SELECT facility_id, facility_name || ' (old)' AS facility_name FROM reduced_plants),
           new_plants AS (SELECT DISTINCT facility_id, facility_name FROM valid_fac)""",
    ),
    "upsert_last_wins": _q(
        _upsert("facility_outages", "fac_inc2", ["date", "facility_id"], _FACT_OUT),
        "fac_inc2 AS (SELECT date, facility_id, capacity, outage + 1.0 AS outage, percent_outage FROM fac_inc)",
    ),
    "upsert_twice": _q(_upsert("facility_outages", "fac_inc", ["date", "facility_id"], _FACT_OUT)),
    "landed_pages": _q(f"""SELECT {_d('date')} AS period, facility_id AS facility, name AS "facilityName" FROM raw_fac"""),
    "refresh_summary": _q(
        """SELECT mode, dataset, rows_processed, CAST(rows_processed AS VARCHAR) || ' rows processed' AS message
           FROM (
             SELECT 'FULL (first run)' AS mode, 'facility_outages' AS dataset, CAST(COUNT(*) AS BIGINT) AS rows_processed
             FROM valid_fac
             UNION ALL SELECT 'FULL (first run)', 'us_outages', CAST(COUNT(*) AS BIGINT) FROM us_outages
             WHERE dayofyear(date) % 89 <> 0
             UNION ALL SELECT 'FULL (first run)', 'plants', CAST(COUNT(DISTINCT facility_id) AS BIGINT) FROM valid_fac) s"""
    ),
    "refresh_then_increment": _q(_upsert("valid_base", "valid_inc", ["date", "facility_id"], _FACT_OUT), _INC_RAW),
    "recover_base": _q(f"SELECT {_d('date')} AS date, facility_id, capacity, outage + 1.0 AS outage, percent_outage FROM valid_fac"),
    "incremental_flat_landing": _q(f"SELECT {_FACT_OUT} FROM valid_fac"),
    "incremental_gap_filled": _q(f"SELECT {_FACT_OUT} FROM valid_fac"),
    "full_refresh_absent_landing": _q(f"SELECT {_FACT_OUT} FROM valid_fac"),
    "incremental_reread_run": _q(_upsert("valid_base", "valid_inc", ["date", "facility_id"], _FACT_OUT), _INC_RAW),
    "incremental_flat_correction": _q(_upsert("valid_base", "valid_inc", ["date", "facility_id"], _FACT_OUT), _INC_RAW),
    "page_walk_pinned": _q(
        f"""SELECT {_d('date')} AS date, facility_id, capacity, outage, percent_outage, CAST(rn AS BIGINT) AS row_idx,
                   CAST(rn // {Q.PAGE_LIMIT} AS BIGINT) AS page_no, CAST(rn % {Q.PAGE_LIMIT} AS BIGINT) AS page_pos
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id) - 1 AS rn FROM valid_fac
                  WHERE date >= DATE '{Q.DATE_FROM}') f"""
    ),
    "stored_page_deep": _q(
        f"""SELECT {_d('date')} AS date, facility_id, capacity, outage, percent_outage, CAST(rn - 1 - off AS BIGINT) AS page_rank
            FROM (SELECT *, row_number() OVER (ORDER BY date DESC, facility_id ASC) AS rn,
                         CAST(floor(COUNT(*) OVER () * {Q.DEEP_SHARE}::DOUBLE) AS BIGINT) AS off FROM facility_outages) f
            WHERE rn > off AND rn <= off + {Q.DEEP_LIMIT}"""
    ),
    "stored_counts": _q(
        f"""SELECT dataset, date_from, date_to, CAST(n AS BIGINT) AS total_count, CAST({Q.META_OFFSET} AS BIGINT) AS "offset",
                   CAST({Q.META_LIMIT} AS BIGINT) AS "limit", CAST(LEAST(GREATEST(n - {Q.META_OFFSET}, 0), {Q.META_LIMIT}) AS BIGINT) AS returned,
                   CASE WHEN {Q.META_OFFSET + Q.META_LIMIT} < n THEN CAST({Q.META_OFFSET + Q.META_LIMIT} AS BIGINT) ELSE -1 END AS next_offset, FALSE AS limit_clamped
            FROM (SELECT 'facility' AS dataset, NULL AS date_from, NULL AS date_to, COUNT(*) AS n FROM facility_outages
                  UNION ALL SELECT 'facility', '{Q.DATE_FROM}', '{Q.DATE_TO}', COUNT(*) FROM facility_outages WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}'
                  UNION ALL SELECT 'facility', '2030-01-01', NULL, COUNT(*) FROM facility_outages WHERE date >= DATE '2030-01-01'
                  UNION ALL SELECT 'us', NULL, '{Q.EARLY_TO}', COUNT(*) FROM us_outages WHERE date <= DATE '{Q.EARLY_TO}'
                  UNION ALL SELECT 'plants', NULL, NULL, COUNT(*) FROM plants) c"""
    ),
    "filter_by_name": _facts("facility_id IN (SELECT facility_id FROM plants WHERE contains(facility_name, '5'))"),
    "series_all_long": _q(
        f"""SELECT facility_id, {_d('day')} AS date, outage,
                   CAST(day - MAX(date) OVER (PARTITION BY facility_id ORDER BY day) AS BIGINT) AS gap, CAST(day - first AS BIGINT) AS day_no
            FROM (SELECT s.facility_id, s.day, s.first, f.date, f.outage
                  FROM (SELECT facility_id, first, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS day
                        FROM (SELECT facility_id, MIN(date) AS first, MAX(date) AS last FROM facility_outages GROUP BY facility_id) r) s
                  LEFT JOIN facility_outages f ON f.facility_id = s.facility_id AND f.date = s.day) j"""
    ),
    "series_by_date": _q(
        f"""SELECT {_d('date')} AS date, CAST(COUNT(*) AS BIGINT) AS n_series,
                   string_agg(facility_id || ':' || printf('%.2f', percent_outage), ';' ORDER BY facility_id) AS series
            FROM facility_outages GROUP BY date"""
    ),
    "upsert_changes": _q(
        f"""SELECT {_d('b.date')} AS date, b.facility_id, b.outage,
                   CASE WHEN t.date IS NULL THEN 'inserted'
                        WHEN b.capacity IS NOT DISTINCT FROM t.capacity AND b.outage IS NOT DISTINCT FROM t.outage
                             AND b.percent_outage IS NOT DISTINCT FROM t.percent_outage THEN 'same' ELSE 'changed' END AS kind
            FROM (SELECT * FROM fac_inc UNION ALL
                  SELECT date, facility_id, capacity, CASE WHEN day(date) = 1 THEN NULL ELSE outage END, percent_outage
                  FROM facility_outages WHERE date <= DATE '{Q.DATE_FROM}') b
            LEFT JOIN facility_outages t ON t.date = b.date AND t.facility_id = b.facility_id"""
    ),
    "stream_gap_filled": _q(f"SELECT {_FACT_OUT} FROM valid_fac"),
    "landed_broken_pages": _q(
        f"""SELECT run, state, reason, CAST(COUNT(*) AS BIGINT) AS pages, CAST(COUNT(place) AS BIGINT) AS placed FROM (
              SELECT 'run-1' AS run, 'kept' AS state, NULL AS reason, g AS place FROM pages
              UNION ALL
              SELECT 'run-2', CASE WHEN g = 0 THEN 'kept' WHEN g % 3 = 0 THEN 'held' ELSE 'broken' END,
                     CASE g % 3 WHEN 1 THEN 'not a page' WHEN 2 THEN 'no response' END, CASE WHEN g % 3 <> 1 THEN g END FROM pages) p
            GROUP BY run, state, reason""",
        f"""pages AS (SELECT unnest(generate_series(0, CAST(ceil(total / {Q.GAP_PAGE}.0) AS BIGINT) - 1)) AS g
                     FROM (SELECT COUNT(*) AS total FROM raw_fac) t)""",
    ),
    "refresh_quality_report": _q(
        f"""SELECT dataset, run, kind, reason, CAST(COUNT(*) AS BIGINT) AS records, CAST(COUNT(DISTINCT date) AS BIGINT) AS days FROM (
              SELECT 'facility_outages' AS dataset, 'run-9' AS run, CASE WHEN {_VALID} THEN 'number' ELSE 'missing' END AS kind,
                     CASE WHEN {_VALID} THEN 'capacity' ELSE 'facilityName' END AS reason, date
              FROM raw_fac WHERE bad_cap OR NOT coalesce({_VALID}, FALSE)
              UNION ALL
              SELECT 'facility_outages', 'run-10', CASE WHEN date < mark THEN 'late' WHEN {_VALID} THEN 'number' ELSE 'missing' END,
                     CASE WHEN date < mark THEN 'before ' || {_d('mark')} WHEN {_VALID} THEN 'capacity' ELSE 'facilityName' END, date
              FROM (SELECT *, (SELECT MAX(date) FROM valid_fac) AS mark FROM raw_inc) r WHERE date < mark OR bad_cap OR NOT coalesce({_VALID}, FALSE)
              UNION ALL
              SELECT 'us_outages', 'run-9', CASE WHEN dayofyear(date) % 89 = 0 THEN 'missing' ELSE 'number' END,
                     CASE WHEN dayofyear(date) % 89 = 0 THEN 'outage' ELSE 'capacity' END, date
              FROM us_outages WHERE dayofyear(date) % 89 = 0 OR dayofyear(date) % 83 = 0) q
            GROUP BY dataset, run, kind, reason""",
        _INC_RAW,
    ),
    "stream_late_rows": _q(
        f"""SELECT 'stored' AS kind, CAST(COUNT(*) AS BIGINT) AS records, {_d('MAX(date)')} AS newest
            FROM valid_fac WHERE year(date) % 2 = 0 OR date >= (SELECT MAX(date) FROM valid_fac WHERE year(date) % 2 = 0) - {Q.LOOKBACK_DAYS}
            UNION ALL
            SELECT 'late', CAST(COUNT(*) AS BIGINT), {_d('MAX(date)')}
            FROM raw_fac WHERE date < (SELECT MAX(date) FROM valid_fac WHERE year(date) % 2 = 0) - {Q.LOOKBACK_DAYS}"""
    ),
    "last_wins_by_page": _q(f"SELECT {_d('date')} AS date, facility_id, outage * 2.0 AS outage FROM valid_fac"),
    "incremental_late_run": _q(_upsert("valid_base", "late_inc", ["date", "facility_id"], _FACT_OUT), _INC_RAW + _LATE),
    "refresh_modes": _q(
        f"""SELECT step, mode, dataset, CAST(n AS BIGINT) AS rows_processed, {_d('mark')} AS last_extraction_date FROM (
            SELECT 1::BIGINT AS step, 'FULL (first run)' AS mode, 'facility_outages' AS dataset, COUNT(*) AS n, MAX(date) AS mark FROM valid_fac
            UNION ALL SELECT 1, 'FULL (first run)', 'us_outages', COUNT(*), MAX(date) FROM us_valid
            UNION ALL SELECT 1, 'FULL (first run)', 'plants', COUNT(DISTINCT facility_id), MAX(date) FROM valid_fac
            UNION ALL SELECT 2, 'INCREMENTAL', 'facility_outages', COUNT(*), MAX(date) FROM late_inc
            UNION ALL SELECT 2, 'INCREMENTAL', 'us_outages', 0, MAX(date) FROM us_valid
            UNION ALL SELECT 2, 'INCREMENTAL', 'plants', (SELECT COUNT(DISTINCT facility_id) FROM late_inc), MAX(date) FROM valid_fac
            UNION ALL SELECT 3, 'INCREMENTAL', 'facility_outages', COUNT(*), (SELECT MAX(date) FROM late_inc) FROM
              (SELECT date, facility_id FROM valid_base UNION SELECT date, facility_id FROM late_inc) u
            UNION ALL SELECT 3, 'INCREMENTAL', 'us_outages', COUNT(*), MAX(date) FROM us_valid
            UNION ALL SELECT 3, 'INCREMENTAL', 'plants',
              (SELECT COUNT(*) FROM (SELECT facility_id FROM valid_base UNION SELECT facility_id FROM late_inc) p), MAX(date) FROM valid_fac) m""",
        _INC_RAW + _LATE + ", us_valid AS (SELECT * FROM us_outages WHERE dayofyear(date) % 89 <> 0)",
    ),
    "held_pages": _q(
        f"""SELECT state, CAST(COUNT(*) AS BIGINT) AS pages FROM (
              SELECT CASE WHEN g = 0 THEN 'kept' ELSE 'held' END AS state
              FROM (SELECT unnest(generate_series(0, CAST(ceil(total / {Q.GAP_PAGE}.0) AS BIGINT) - 1)) AS g
                    FROM (SELECT COUNT(*) AS total FROM raw_fac) t) s WHERE g <> 1) p GROUP BY state"""
    ),
    "landed_range": _q(
        f"""SELECT {_d('date')} AS period, facility_id AS facility, name AS "facilityName" FROM raw_fac
            WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}'"""
    ),
    "landed_range_indexed": _q(
        f"""SELECT {_d('date')} AS period, facility_id AS facility, name AS "facilityName" FROM raw_fac
            WHERE date BETWEEN DATE '{Q.DATE_FROM}' AND DATE '{Q.DATE_TO}'"""
    ),
    "quarantine_bad_dates": _q(
        f"""SELECT * FROM (SELECT CASE WHEN dayofyear(date) % 71 = 0 THEN strftime(date, '%Y-%m') ELSE {_d('date')} END AS period,
                   facility_id AS facility,
                   concat_ws(', ', CASE WHEN NOT ({_VALID}) OR name IS NULL THEN 'facilityName' END,
                     CASE WHEN dayofyear(date) % 24 = 0 THEN 'capacity' END,
                     CASE WHEN dayofyear(date) % 71 = 0 THEN 'period (not a date)' END) AS missing_fields
            FROM raw_fac) q WHERE missing_fields <> ''"""
    ),
    "refreshed_us": _q(
        f"""SELECT {_d('date')} AS date, CASE WHEN dayofyear(date) % 83 = 0 THEN NULL ELSE capacity END AS capacity,
                   outage, percent_outage FROM us_outages WHERE dayofyear(date) % 89 <> 0"""
    ),
    "stream_us": _q(
        f"""SELECT {_d('date')} AS date, CASE WHEN dayofyear(date) % 83 = 0 THEN NULL ELSE capacity END AS capacity,
                   outage, percent_outage FROM us_outages WHERE dayofyear(date) % 89 <> 0"""
    ),
    "refreshed_plants": _q("SELECT DISTINCT facility_id, facility_name FROM valid_fac"),
    "series_full_range": _q(
        f"""SELECT r.facility_id, p.facility_name, {_d('r.date')} AS date, r.outage, CAST(r.rk AS BIGINT) AS series_rank
            FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY date DESC) AS rk
                  FROM facility_outages WHERE facility_id IN ({_ALL_PICKED})) r
            JOIN plants p ON p.facility_id = r.facility_id"""
    ),
    "series_labels": _q(
        f"""SELECT facility_id, facility_name AS label, CAST(row_number() OVER (ORDER BY facility_id) AS BIGINT) AS series_no
            FROM plants WHERE facility_id IN ({_ALL_PICKED})"""
    ),
    "series_many": _q(
        f"""SELECT {_d('date')} AS date, {", ".join(f"MAX(CASE WHEN series = '{v}' THEN outage END) AS \"{v}\"" for v in ["us", *_MANY_IDS])},
                   CAST(row_number() OVER (ORDER BY date) AS BIGINT) AS date_rank
            FROM (SELECT date, 'us' AS series, outage FROM us_outages WHERE date <= DATE '{Q.SERIES_TO}'
                  UNION ALL SELECT date, facility_id, outage FROM facility_outages
                  WHERE date <= DATE '{Q.SERIES_TO}' AND facility_id IN ({_ALL_PICKED})) l GROUP BY date"""
    ),
    "stream_refresh": _q(f"SELECT {_FACT_OUT} FROM valid_fac"),
    "snapshot_roundtrip": _us(),
}
