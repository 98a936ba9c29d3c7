"""Paged, filtered, name-enriched reads (the ``/data`` request as Spark plans).

``get_dataset`` checks its scalar arguments on the driver (P15, L4), then
locates the page by counts per date, reads it (at most ``max_limit`` rows, held
by the driver) and returns it joined with names, plus a lazy 1-row metadata
DataFrame whose total count is its own aggregate. Reads write nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reactorlake.errors import DataNotFoundError, ProcessingError, ValidationError
from reactorlake.functions.dates import format_date, parse_date, parse_date_arg
from reactorlake.functions.labels import record_json
from reactorlake.operators import read as R
from reactorlake.operators.numbering import number_pages
from reactorlake.schemas import DATASETS, DEFAULT_LIMIT, MAX_LIMIT, resolve
from reactorlake.sources.tables import READ_ERRORS


class Catalog(Protocol):
    def load(self, name: str, date_from=None, date_to=None) -> DataFrame:
        """The dataset; date bounds are a pruning hint (callers still filter).

        A catalog that knows them also has ``rows_per_date(name, date_from, date_to)`` and
        ``row_count(name)``; pages and counts are then found without reading the facts."""
        ...


class FrameCatalog:
    """A catalog over already-built DataFrames keyed by storage name."""

    def __init__(self, frames: Mapping[str, DataFrame]):
        self.frames = dict(frames)

    def load(self, name: str, date_from=None, date_to=None) -> DataFrame:
        ds = resolve(name)
        if ds.storage not in self.frames:
            raise DataNotFoundError(f"Dataset '{ds.public}' not found")
        return self.frames[ds.storage]


@dataclass
class PageResult:
    data: DataFrame  # the page, in order, with ``page_rank``
    meta: DataFrame  # total_count, offset, limit, returned, next_offset


@dataclass(frozen=True)
class ReadArgs:
    dataset: str
    date_from: object
    date_to: object
    facility_id: str | None
    offset: int
    limit: int
    requested: int


# The parts of the messages that callers match on.
MUST_BE_KNOWN = "Invalid dataset"
ONLY_FACILITY = "only allowed for 'facility'"


def check_args(
    dataset: str,
    date_from=None,
    date_to=None,
    facility_id: str | None = None,
    offset: int = 0,
    limit: int = DEFAULT_LIMIT,
    max_limit: int = MAX_LIMIT,
) -> ReadArgs:
    """Every bad argument is a ValidationError; a limit above
    ``max_limit`` is clamped, and the metadata says so."""
    if dataset not in DATASETS:
        raise ValidationError(f"{MUST_BE_KNOWN}: {dataset!r} is none of {', '.join(DATASETS)}")
    if offset is None or limit is None or offset < 0 or limit < 1:
        raise ValidationError("a page needs an offset of 0 or more and a limit of 1 or more")
    requested, limit = int(limit), min(int(limit), max_limit)
    d_from = parse_date_arg(date_from, "date_from")
    d_to = parse_date_arg(date_to, "date_to")
    if d_from is not None and d_to is not None and d_from > d_to:
        raise ValidationError("the range ends before it starts: date_from is after date_to")
    if facility_id not in (None, "") and dataset != "facility":
        raise ValidationError(f"a facility_id is {ONLY_FACILITY} reads")
    return ReadArgs(dataset, d_from, d_to, facility_id or None, int(offset), limit, requested)


def argument_fault(dataset: str, date_from: str, date_to: str, facility_id: str) -> Column:
    """P15 / D3 / D6 for requests held in columns: what a read would be refused for (the
    first rule it breaks, as in ``check_args``), or NULL."""

    def given(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c) != "")

    def bad(c: str) -> Column:
        return given(c) & parse_date(c).isNull()

    return (
        F.when(~F.coalesce(F.col(dataset).isin(*DATASETS), F.lit(False)), "dataset")
        .when(bad(date_from), "date_from")
        .when(bad(date_to), "date_to")
        .when(F.coalesce(parse_date(date_from) > parse_date(date_to), F.lit(False)), "range")
        .when(given(facility_id) & (F.col(dataset) != "facility"), "facility_id")
    )


def filtered_rows(catalog: Catalog, args: ReadArgs) -> DataFrame:
    ds = DATASETS[args.dataset]
    df = catalog.load(ds.storage, args.date_from, args.date_to)  # month folders pruned by the catalog
    df = R.filter_date_range(df, args.date_from, args.date_to)  # skipped for plants (D4)
    return R.filter_facility(df, ds, args.facility_id)


def _plants_or_none(catalog: Catalog) -> DataFrame | None:
    """Only an absent dimension is tolerated; real errors surface."""
    try:
        return catalog.load("plants")
    except DataNotFoundError:
        return None


def _known_rows(catalog: Catalog, args: ReadArgs) -> tuple[dict | None, int | None]:
    """(rows per date, total rows) of a read, where the catalog knows them without reading the table."""
    ds = DATASETS[args.dataset]
    if args.facility_id is not None or not hasattr(catalog, "rows_per_date"):
        return None, None
    if not ds.has_date:
        return None, catalog.row_count(ds.public)
    days = catalog.rows_per_date(ds.public, args.date_from, args.date_to)
    return days, None if days is None else sum(days.values())


def get_dataset(
    catalog: Catalog,
    dataset: str,
    date_from=None,
    date_to=None,
    facility_id: str | None = None,
    offset: int = 0,
    limit: int = DEFAULT_LIMIT,
    max_limit: int = MAX_LIMIT,
) -> PageResult:
    args = check_args(dataset, date_from, date_to, facility_id, offset, limit, max_limit)
    ds = DATASETS[args.dataset]
    filtered = filtered_rows(catalog, args)
    days, total = _known_rows(catalog, args)
    if days is not None:
        spot = R.locate_in(days, args.offset, args.limit)
        if spot is not None:  # only the months of the page are opened
            filtered = catalog.load(ds.storage, spot[1], spot[0])
    # The page (at most max_limit rows) is read once and held by the driver: the name
    # join needs its ids, and neither it nor the count scans the facts for the page again.
    try:
        found = R.page(filtered, ds, args.offset, args.limit, days)
        pg = filtered.sparkSession.createDataFrame(found.collect(), found.schema)
    except READ_ERRORS as exc:  # files that are gone or broken show only when they are read
        raise ProcessingError(f"{ds.public} can't be read") from exc
    meta = R.page_metadata(filtered, args.offset, args.limit, args.requested, total)
    data = pg
    if ds.public == "facility":
        data = R.join_names(data, _plants_or_none(catalog))
    # Order after the join: the page is re-sorted (bounded) rather than trusting join order.
    data = R.with_page_rank(data, ds)
    if ds.has_date:
        data = data.withColumn("date", format_date("date"))
    return PageResult(data.orderBy("page_rank"), meta)


def all_pages(
    catalog: Catalog,
    dataset: str,
    date_from=None,
    date_to=None,
    facility_id: str | None = None,
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """The whole filtered result numbered into pages of ``limit`` rows
    (``page_no``, ``page_pos``), in the read order; what walking every page
    with ``next_offset`` returns, computed once. The numbering is stored in the
    shared folder, so each page is then a cheap ``page_no`` filter. Names are
    joined for facility rows (whole-table join: the dimension is broadcast only
    under the size threshold)."""
    args = check_args(dataset, date_from, date_to, facility_id, 0, limit)
    ds = DATASETS[args.dataset]
    numbered = number_pages(filtered_rows(catalog, args), R.sort_columns(ds), args.limit)
    if ds.public == "facility":
        plants = _plants_or_none(catalog)
        if plants is not None:
            numbered = R.join_names_whole(numbered, plants)
    if ds.has_date:
        numbered = numbered.withColumn("date", format_date("date"))
    return numbered


def page_records(result: PageResult) -> DataFrame:
    """F16: each page row as one JSON object, in page order."""
    cols = [c for c in result.data.columns if c != "page_rank"]
    return result.data.select("page_rank", record_json(*cols).alias("record"))


def overview(
    catalog: Catalog,
    date_from=None,
    date_to=None,
    facility_id: str | None = None,
    offset: int = 0,
    limit: int = DEFAULT_LIMIT,
) -> dict[str, PageResult]:
    """No dataset named -> all three results, each with its own count and
    page; dates do not apply to plants (D4). A ``facility_id`` implies the
    facility dataset alone (D3)."""
    if facility_id not in (None, ""):
        return {"facility": get_dataset(catalog, "facility", date_from, date_to, facility_id, offset, limit)}
    return {name: get_dataset(catalog, name, date_from, date_to, None, offset, limit) for name in DATASETS}


def overview_frame(results: dict[str, PageResult]) -> DataFrame:
    """U2 as one frame: pages unioned by name with a ``dataset`` tag and each
    dataset's ``total_count`` (missing columns are NULL)."""
    frames = []
    for name, res in results.items():
        # the dataset's count is a scalar subquery over its 1-row metadata (no join)
        total = res.meta.select("total_count").scalar()
        frames.append(res.data.withColumns({"dataset": F.lit(name), "total_count": total}))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
