"""Filters and names of queries, with the clock fixed."""

import datetime as dt

import pytest

from tallyloom.operators.filters import ranges_of
from tallyloom.operators.query import check_tags, resolve
from tallyloom.schema import Schema
from tallyloom.types import DimensionType, Filter, FloatRange, IntRange, QuerySpec, SchemaSpec, StringRange, TimeRange, ValidationError, ViewSpec, loads
from quotes import SPEC

NOW = dt.datetime.fromtimestamp(151, dt.timezone.utc)


def at(seconds):
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc)


def s(n):
    return dt.timedelta(seconds=n)


@pytest.mark.parametrize(
    "kind, filter_, expected",
    [
        (DimensionType.VARINT, Filter(ints=[IntRange(end=110), IntRange(120, 130), IntRange(150)]), [(None, 110), (120, 130), (150, None)]),
        (DimensionType.VARINT, Filter(ints=[IntRange(0, 110)]), [(None, 110)]),
        (DimensionType.FLOAT, Filter(floats=[FloatRange(end=110.0), FloatRange(120.0, 130.0), FloatRange(150.0, 0.0)]), [(None, 110.0), (120.0, 130.0), (150.0, None)]),
        (DimensionType.STRING, Filter(strings=[StringRange("", "b"), StringRange("c", "d"), StringRange("e", "")]), [(None, "b"), ("c", "d"), ("e", None)]),
        (DimensionType.TIMESTAMP, Filter(times=[TimeRange(end=at(110)), TimeRange(at(120), at(130)), TimeRange(at(150))]), [(None, at(110)), (at(120), at(130)), (at(150), None)]),
        (DimensionType.TIMESTAMP, Filter(times=[TimeRange(relative_end=s(-41)), TimeRange(relative_begin=s(-31), relative_end=s(-21)), TimeRange(relative_begin=s(-1))]), [(None, at(110)), (at(120), at(130)), (at(150), None)]),
        (DimensionType.TIMESTAMP, Filter(times=[TimeRange(begin=at(7), relative_begin=s(-1))]), [(at(7), None)]),
    ],
)
def test_ranges(kind, filter_, expected):
    assert ranges_of(filter_, kind, NOW) == expected


@pytest.mark.parametrize("kind, word", [(DimensionType.VARINT, "Ints"), (DimensionType.FLOAT, "Floats"), (DimensionType.STRING, "Strings"), (DimensionType.TIMESTAMP, "Times")])
def test_ranges_of_the_dimensions_type_are_needed(kind, word):
    with pytest.raises(ValidationError, match=f"expected {word}"):
        ranges_of(Filter(), kind, NOW)


@pytest.mark.parametrize("ints", [[IntRange(456, 123)], [IntRange(123, 456), IntRange(455, 789)], [IntRange(123), IntRange(456)], [IntRange(1, 5), IntRange(5, 9)], [IntRange(1, 2), IntRange(end=9)]])
def test_range_order(ints):
    with pytest.raises(ValidationError, match="invalid range order"):
        ranges_of(Filter(ints=ints), DimensionType.VARINT, NOW)


def spec(view="quote_stats", dims=("author",), mets=("sum_quotes",), filters=()):
    return QuerySpec(view, ViewSpec(list(dims), list(mets)), list(filters))


@pytest.mark.parametrize(
    "query, message",
    [
        (spec(view="nope"), r"no such MaterializedView \(nope\)"),
        (spec(dims=["nope"]), r"View\.Dimensions\[0\]: no such Dimension \(nope\)"),
        (spec(dims=["author", "word"]), r"View\.Dimensions\[1\]: not part of MaterializedView \(word\)"),
        (spec(dims=["author", "author"]), r"View\.Dimensions\[1\]: duplicated Dimension \(author\)"),
        (spec(mets=["nope"]), r"View\.Metrics\[0\]: no such Metric \(nope\)"),
        (spec(mets=["last_quote"]), r"View\.Metrics\[0\]: not part of MaterializedView \(last_quote\)"),
        (spec(mets=["sum_quotes", "sum_quotes"]), r"View\.Metrics\[1\]: duplicated Metric \(sum_quotes\)"),
        (spec(filters=[Filter("nope")]), r"Filters\[0\]: no such Dimension \(nope\)"),
        (spec(filters=[Filter("word", strings=[StringRange("a")])]), r"Filters\[0\]: Dimension is not part of MaterializedView \(word\)"),
        (spec(filters=[Filter("quote_id", ints=[IntRange(1)]), Filter("quote_id", ints=[IntRange(1)])]), r"Filters\[1\]: duplicated Dimension \(quote_id\)"),
        (spec(filters=[Filter("quote_id", ints=[IntRange(9, 1)])]), r"Filters\[0\]: invalid range order"),
    ],
)
def test_query_errors(query, message):
    with pytest.raises(ValidationError, match=f"^{message}$"):
        resolve(Schema(loads(SchemaSpec, SPEC)), query, NOW)


def test_resolved_by_tags():
    schema = Schema(loads(SchemaSpec, SPEC))
    r = resolve(schema, loads(QuerySpec, "{materialized_view: recent, view: {dimensions: [author]}, filters: [{dimension: quote_time, times: [{relative_begin: -60s}]}]}"), NOW)
    assert (r.view, r.dimensions, r.metrics, r.filters) == (3, (4,), (), ((7, ((at(91), None),)),))
    check_tags(schema, r)
    with pytest.raises(ValidationError, match=r"MvTag not found \(99\)"):
        check_tags(schema, r.__class__(99, (), ()))
    with pytest.raises(ValidationError, match="MetTag not part of MaterializedView"):
        check_tags(schema, r.__class__(3, (), (1,)))
