"""The quotes fixture: authors and what they said, by word and by quote."""

import datetime as dt


from tallyloom.functions.words import word_rows
from tallyloom.schema import Extractors, Schema
from tallyloom.types import SchemaSpec, loads

SPEC = """
mappings:
  - {name: quote, tag: 16}
  - {name: quote_words, tag: 17}
dimensions:
  - {name: one, type: VARINT, tag: 1}
  - {name: quote_count, type: VARINT, tag: 2}
  - {name: quote_id, type: VARINT, tag: 3}
  - {name: author, type: STRING, tag: 4}
  - {name: word, type: STRING, tag: 5}
  - {name: word_total, type: VARINT, tag: 6}
  - {name: quote_time, type: TIMESTAMP, tag: 7}
metrics:
  - {name: sum_quotes, dimension: quote_count, type: VARINT_SUM, tag: 1}
  - {name: sum_word_quotes, dimension: one, type: VARINT_SUM, tag: 2}
  - {name: sum_words, dimension: word_total, type: VARINT_SUM, tag: 3}
  - {name: unique_words, dimension: word, type: STRING_HLL, tag: 4}
  - {name: last_quote, dimension: quote_id, type: VARINT_GAUGE, tag: 5}
relations:
  - {name: quote_rows, tag: 1, mapping: quote_words, dimensions: [one, quote_count, quote_id, author, word, word_total, quote_time], selector: {include: {labels: [{name: kind, value: quote}]}}}
views:
  - {name: word_stats, tag: 1, relation: quote_rows, view: {dimensions: [word, author], metrics: [sum_word_quotes, last_quote, sum_words]}}
  - {name: quote_stats, tag: 2, relation: quote_rows, view: {dimensions: [author, quote_id], metrics: [sum_quotes, sum_word_quotes, sum_words, unique_words]}}
  - {name: recent, tag: 3, relation: quote_rows, view: {dimensions: [quote_id, author, quote_time], metrics: []}, retention: {remove_after: 1m, relative_to: quote_time}}
"""

#: Three quotes, and what the views hold of them.
QUOTES = [(123, "John Doe", "One two, one four?"), (456, "Doe Jane", "Two, two one!"), (789, "Doe Jane", "one one.")]
QUOTE_STATS = [("Doe Jane", 456, 1, 2, 3, 2), ("Doe Jane", 789, 1, 1, 2, 1), ("John Doe", 123, 1, 3, 4, 3)]
WORD_STATS = [("four", "John Doe", 1, 123, 1), ("one", "Doe Jane", 2, 789, 3), ("one", "John Doe", 1, 123, 2), ("two", "Doe Jane", 1, 456, 2), ("two", "John Doe", 1, 123, 1)]
SCHEMA = "id long, author string, text string, time timestamp"


def extractors():
    return Extractors(
        new_source=lambda df: df,
        mappings={16: lambda df: df, 17: lambda df: word_rows(df, "text")},
        ints={1: "1", 2: "first_count", 3: "id", 6: "word_count"},
        strings={4: "author", 5: "word"},
        times={7: "time"},
        order_by={17: ["id"]},
    )


def schema():
    return Schema(loads(SchemaSpec, SPEC), extractors())


def frame(spark, rows=QUOTES, at=dt.datetime(2024, 1, 1)):
    return spark.createDataFrame([(*r, at) for r in rows], SCHEMA)


def tuples(df):
    return [tuple(r) for r in df.collect()]
