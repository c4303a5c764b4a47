"""Table descriptions: the only place that knows column names, kinds and keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column kind -> (type inside the JSON envelope, stored type, default
# for a null or missing value, number of values of the unsigned type or None).
KINDS = {
    "string": (T.StringType(), T.StringType(), "", None),
    "list": (T.StringType(), T.ArrayType(T.StringType()), (), None),
    "uint8": (T.LongType(), T.ShortType(), 0, 2**8),
    "uint16": (T.LongType(), T.IntegerType(), 0, 2**16),
    "uint32": (T.LongType(), T.LongType(), 0, 2**32),
    "int64": (T.LongType(), T.LongType(), 0, None),
    "float32": (T.DoubleType(), T.FloatType(), 0.0, None),
    "float64": (T.DoubleType(), T.DoubleType(), 0.0, None),
    "decimal3_1": (T.DoubleType(), T.DecimalType(3, 1), 0, None),
}

# Columns every changelog row carries after the table's own columns.
LOG_COLUMNS = [
    ("cdc_operation", T.StringType()),
    ("cdc_timestamp", T.TimestampType()),
    ("is_deleted", T.ShortType()),
    ("processing_time", T.TimestampType()),
    ("topic", T.StringType()),
    ("partition", T.IntegerType()),
    ("offset", T.LongType()),
    ("yyyymm", T.IntegerType()),
]

# Total order of a key's versions. The timestamp alone ties within a second.
VERSION_ORDER = ("cdc_timestamp", "offset")


@dataclass(frozen=True)
class Column:
    name: str
    kind: str

    @property
    def json_type(self) -> T.DataType:
        return KINDS[self.kind][0]

    @property
    def stored_type(self) -> T.DataType:
        return KINDS[self.kind][1]

    @property
    def default(self):
        return KINDS[self.kind][2]

    @property
    def modulus(self) -> int | None:
        return KINDS[self.kind][3]


@dataclass(frozen=True)
class TableSpec:
    """A replicated table.

    ``keys`` identify a row in the versioned log; ``source_pk`` identifies it at the
    source. They differ for one table, where the log key has one column more, so an
    update of that column leaves the old row active. Pass ``spec.source_pk`` to the
    version operators to get the corrected behaviour.
    """

    name: str
    columns: tuple[Column, ...]
    keys: tuple[str, ...]
    source_pk: tuple[str, ...] = field(default=())
    append_sort: tuple[str, ...] = field(default=())

    def __post_init__(self):
        names = set(self.names)
        if not self.source_pk:
            object.__setattr__(self, "source_pk", self.keys)
        if not self.append_sort:
            object.__setattr__(self, "append_sort", self.keys + ("cdc_timestamp",))
        missing = (set(self.keys) | set(self.source_pk)) - names
        if missing:
            raise ValueError(f"{self.name}: key columns {sorted(missing)} are not columns")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def values(self) -> list[str]:
        """Non-key columns."""
        return [n for n in self.names if n not in self.keys]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    @property
    def row_schema(self) -> T.StructType:
        """Row image as it appears in the envelope: list columns are comma-joined text."""
        return T.StructType([T.StructField(c.name, c.json_type) for c in self.columns])

    def schema_of(self, names: tuple[str, ...]) -> T.StructType:
        return T.StructType([f for f in self.row_schema.fields if f.name in names])

    @property
    def envelope_schema(self) -> T.StructType:
        return self._envelope(self.row_schema)

    @property
    def decode_schema(self) -> T.StructType:
        """What decoding reads: of the before image only the keys, so the parser skips the rest."""
        return self._envelope(self.schema_of(self.keys))

    def _envelope(self, before: T.StructType) -> T.StructType:
        return T.StructType(
            [
                T.StructField("op", T.StringType()),
                T.StructField("before", before),
                T.StructField("after", self.row_schema),
                T.StructField("ts_ms", T.LongType()),
            ]
        )

    @property
    def log_schema(self) -> T.StructType:
        own = [T.StructField(c.name, c.stored_type) for c in self.columns]
        return T.StructType(own + [T.StructField(n, t) for n, t in LOG_COLUMNS])


def table(name: str, columns: str, keys: str, source_pk: str = "", append_sort: str = "") -> TableSpec:
    """``table("t", "id:string votes:uint32", "id")`` - compact spec notation."""
    cols = tuple(Column(*c.split(":")) for c in columns.split())
    return TableSpec(
        name, cols, tuple(keys.split()), tuple(source_pk.split()), tuple(append_sort.split())
    )


# The seven title and name tables.
TITLE_TABLES = {
    s.name: s
    for s in (
        table(
            "title_ratings",
            "tconst:string averageRating:float32 numVotes:uint32",
            keys="tconst",
        ),
        table(
            "title_basics",
            "tconst:string titleType:string primaryTitle:string originalTitle:string"
            " isAdult:uint8 startYear:uint16 endYear:uint16 runtimeMinutes:uint16 genres:list",
            keys="tconst",
            append_sort="titleType startYear tconst",
        ),
        table(
            "name_basics",
            "nconst:string primaryName:string birthYear:uint16 deathYear:uint16"
            " primaryProfession:list knownForTitles:list",
            keys="nconst",
            append_sort="primaryName nconst",
        ),
        table("title_crew", "tconst:string directors:list writers:list", keys="tconst"),
        table(
            "title_episode",
            "tconst:string parentTconst:string seasonNumber:uint16 episodeNumber:uint16",
            keys="tconst",
            append_sort="parentTconst seasonNumber episodeNumber tconst",
        ),
        table(
            "title_akas",
            "titleId:string ordering:uint16 title:string region:string language:string"
            " types:list attributes:list isOriginalTitle:uint8",
            keys="titleId ordering",
        ),
        table(
            "title_principals",
            "tconst:string ordering:uint16 nconst:string category:string job:string characters:list",
            keys="tconst ordering nconst",
            source_pk="tconst ordering",
            append_sort="tconst ordering nconst",
        ),
    )
}
