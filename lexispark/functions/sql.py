"""The functions over patterns for use in Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexispark.functions.sequences import GAP, MISSING

_ROWS = "array<array<string>>"
#: name: (parameters, type, body). Patterns are arrays of sounds, one for each doculect; rows are several patterns.
FUNCTIONS = {
    "pattern_matches": (
        "a array<string>, b array<string>", "int",
        f"size(filter(arrays_zip(a, b), z -> z.a = z.b and z.a not in ('{MISSING}', '{GAP}')))",
    ),
    "pattern_mismatches": (
        "a array<string>, b array<string>", "int",
        f"size(filter(arrays_zip(a, b), z -> z.a <> z.b and z.a <> '{MISSING}' and z.b <> '{MISSING}'))",
    ),
    "patterns_fit": ("a array<string>, b array<string>", "boolean", "pattern_matches(a, b) > 0 and pattern_mismatches(a, b) = 0"),
    "pattern_columns": (
        f"p {_ROWS}", _ROWS,
        f"transform(sequence(0, size(p[0]) - 1), i -> filter(transform(p, r -> r[i]), x -> x <> '{MISSING}'))",
    ),
    "incompatible_columns": (f"p {_ROWS}", "array<string>", "transform(pattern_columns(p), c -> if(size(array_distinct(c)) > 1, '*', ''))"),
    "consensus_pattern": (
        f"p {_ROWS}", "array<string>",
        f"if(array_contains(incompatible_columns(p), '*'), cast(null as array<string>), transform(pattern_columns(p), c -> coalesce(get(c, 0), '{MISSING}')))",
    ),
    "_fills": (f"p {_ROWS}", "array<int>", "transform(pattern_columns(p), c -> size(c))"),
    "_row_fills": (f"p {_ROWS}", "array<int>", f"transform(p, r -> size(filter(r, x -> x <> '{MISSING}')))"),
    "_total": ("v array<double>", "double", "aggregate(v, 0.0D, (s, x) -> s + x)"),
    "_ranked": (  # the fullest column weighs most, of equal ones the first
        "v array<int>", "double",
        "_total(transform(transform(sort_array(transform(v, (n, i) -> struct(n as n, -i as i))), z -> z.n), (n, i) -> cast((i + 1) * n as double))) / (size(v) * (size(v) + 1) / 2.0D)",
    ),
    "score_patterns": (
        f"p {_ROWS}, mode string", "double",
        """case when size(p) = 0 or array_contains(incompatible_columns(p), '*') or size(p) <= 1 then -1.0D
        when mode = 'coverage' then _total(transform(_fills(p), n -> cast(n as double))) / size(p[0]) / size(p)
        when mode = 'ranked' then _ranked(_fills(p)) / size(p)
        when mode = 'squared' then _total(transform(_row_fills(p), n -> power(n / size(p[0]), 2))) / size(p)
        when mode = 'pairs' then (_total(transform(_row_fills(p), n -> n * (n - 1) / 2.0D)) + _total(transform(_fills(p), n -> n * (n - 1) / 2.0D))) / size(p)
            / size(filter(_fills(p), n -> n > 0)) / size(p[0])
        else cast(raise_error('mode must be ranked, pairs, squared or coverage') as double) end""",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session, for spark.sql and F.expr. All are SQL: Catalyst sees through them.

    consensus_pattern, incompatible_columns and score_patterns take the patterns of a group, as collect_list gives them; a consensus of
    patterns that conflict is null, a score of such or of one pattern alone is -1.
    """
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {kind} return {body}")
