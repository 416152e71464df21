"""JSON of any depth and events of evidence, worked by hand."""

import json

from quillspan.operators import runs

PAIR = "id int, a string, b string"


def nested(depth, leaf, reverse=False):
    for k in range(depth):
        own = {"k": leaf, "n": k} if k % 2 else {"k": leaf, "list": [{"x": 1, "y": {"b": 2, "a": k}}]}
        leaf = dict(reversed(own.items())) if reverse else own
    return json.dumps(leaf)


def shuffled(text):
    turn = lambda v: {k: turn(x) for k, x in reversed(v.items())} if isinstance(v, dict) else [turn(x) for x in v] if isinstance(v, list) else v
    return json.dumps(turn(json.loads(text)))


def test_objects_of_any_depth(spark):
    deep = nested(40, "end")
    pairs = [
        (1, deep, shuffled(deep)),  # other orders of keys, also inside arrays
        (2, deep, nested(40, "other")),
        (3, '{"a": [1, 2]}', '{"a": [2, 1]}'),
        (4, '{"a": {}, "b": null}', "{}"),
        (5, '{"a": {"b": {"c": "1"}}}', '{"a": "{}"}'),
        (6, '{"a": 1, "a": 2}', '[{"a": 1}]'),
        (7, None, '{"x": "", "y": false}'),
        (8, '{"r": {"v1": "x", "v2": "y"}}', '{"r": {"v2": "y", "v1": "z"}}'),
    ]
    got = sorted(tuple(r) for r in runs.config_field_diff(spark.createDataFrame(pairs, PAIR)).collect())
    assert got == [
        (2, ".".join(["k"] * 40), "end", "other"),
        (3, "a", "[1,2]", "[2,1]"),
        (5, "a", "", "{}"),
        (5, "a.b.c", "1", ""),
        (7, "y", "", "false"),
        (8, "r.v1", "x", "z"),
    ]
    assert runs.config_field_diff(spark.createDataFrame([], PAIR)).count() == 0


def test_each_configuration_is_opened_once(spark, monkeypatch):
    configs = [("r", 1, '{"a": {"b": "1"}, "c": 2}'), ("r", 3, '{"a": {"b": "2"}, "c": 2}'), ("r", 4, None), ("r", 6, '{"c": 3}'), ("r", 7, '{"c": 3, "d": "x"}'), ("s", 1, '{"c": 9}'), (None, 1, '{"c": 1}'), (None, 2, "{}")]
    opened, written = [], runs.written
    monkeypatch.setattr(runs, "written", lambda df, name: opened.append(written(df, name)) or opened[-1])
    got = {tuple(r) for r in runs.instrument_changes(spark.createDataFrame(configs, "run string, seq int, config string")).collect()}
    assert got == {("r", 3, "a.b", "1", "2"), ("r", 4, "a.b", "2", ""), ("r", 4, "c", "2", ""), ("r", 7, "d", "", "x"), (None, 2, "c", "1", "")}
    assert [level.count() for level in opened] == [9, 2]


def test_numbers_of_metrics(spark):
    frame = spark.createDataFrame([("r", '{"n": 3, "rate": -0.25, "big": 1e30, "text": "4", "on": true, "none": null, "deep": {"x": 1}, "list": [1]}'), ("s", "no json"), ("t", None)], "run string, metrics string")
    assert {(r.run, r.metric): r.value for r in runs.numeric_metrics(frame).collect()} == {("r", "n"): 3.0, ("r", "rate"): -0.25, ("r", "big"): 1e30}


def test_events_follow_declared_sets(spark):
    iterations = spark.createDataFrame([("r", 1, "a1"), ("r", 2, "a2"), ("r", 4, "a4"), ("r", 5, None), ("r", 6, "a6"), ("q", 1, "a1")], "run string, seq int, analysis string")
    declared = spark.createDataFrame([("r", 1, "x"), ("r", 1, " y "), ("r", 2, "x"), ("r", 5, "x"), ("r", 5, "z"), ("r", 6, "y"), ("r", 6, "x"), ("q", 1, "x"), ("q", 1, "x"), ("r", 1, " "), ("r", 3, "lost")], "run string, seq int, ref string")
    added = spark.createDataFrame([("r", 1, "w"), ("r", 2, "y"), ("r", 4, "y"), ("r", 4, "x"), ("r", 6, "w"), ("r", 6, None)], "run string, seq int, ref string")
    documents = spark.createDataFrame([("a1", "d", "h1", "m1"), ("a2", "d", "h2", "m2"), ("a4", "d", "h2", "m3"), ("a2", "e", "h", "m"), ("a4", "e", "h", "m"), ("a4", "f", "h", "m"), ("a6", "d", "h9", "m9")], "analysis string, ref string, hash string, definition string")
    got = {(r.run, r.seq, r.ref, r.event) for r in runs.evidence_events(iterations, declared, added, documents).collect()}
    assert got == {
        ("r", 1, "x", "ADDED"), ("r", 1, "y", "ADDED"), ("r", 1, "w", "ADDED"), ("q", 1, "x", "ADDED"),
        ("r", 2, "y", "REMOVED"),  # declared before, not now; that it was added here again does not save it
        ("r", 4, "y", "ADDED"),  # comes back; nothing is declared here, so x stays
        ("r", 5, "z", "ADDED"),
        ("r", 6, "z", "REMOVED"),  # y and w were seen; w was never declared
        ("r", 2, "d", "CONTENT_CHANGED"),  # content hides the definition
        ("r", 4, "d", "DEFINITION_CHANGED"),
    }


def test_events_make_no_row_for_an_iteration_without_a_mention(spark):
    iterations = spark.createDataFrame([("r", k, None) for k in range(400)], "run string, seq int, analysis string")
    declared = spark.createDataFrame([("r", 0, f"x{k}") for k in range(300)] + [("r", 399, "x1")], "run string, seq int, ref string")
    none = spark.createDataFrame([], "run string, seq int, ref string")
    documents = spark.createDataFrame([], "analysis string, ref string, hash string, definition string")
    found = runs.evidence_events(iterations, declared, none, documents)
    assert found.count() == 300  # the iterations between declare nothing, so nothing is removed
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
