"""Searches by VARIANT and recursion give what the walks over decoded documents give."""

import json
import random

from terrasift.sources import records as R
from terrasift.sources import trees as S

NAMES = ["property", "listResults", "roomType", "Features", "b", "a", "name", "x.y", "é"]


def made(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.3:
        return rng.choice(["s", " ", "", "é\n", 1, -2, True, None, "long " * 3])
    if kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    names = rng.sample(NAMES, rng.randint(0, 4))
    return {name: made(rng, depth + 1) for name in names}


def documents():
    rng = random.Random(8)
    deep = json.dumps("x")
    for _ in range(60):
        deep = '{"b":[%s]}' % deep
    docs = {str(i): json.dumps(made(rng), ensure_ascii=rng.random() < 0.5) for i in range(150)}
    return docs | {"deep": deep.replace('"x"', '{"listResults":[{"property":{"name":"deep"}}]}'), "bad": "{", "empty": "", "null": "null", "none": None, "twice": '{"a":1,"a":2}'}


def decoded(text):
    try:
        return R.decode(text) if text else None
    except ValueError:
        return None


def numbers(value):
    """Numbers as written to numbers."""
    if isinstance(value, R.Number):
        return json.loads(value)
    if isinstance(value, dict):
        return {k: numbers(v) for k, v in value.items()}
    return [numbers(v) for v in value] if isinstance(value, list) else value


def test_against_walks(spark):
    docs = {k: v for k, v in documents().items() if k != "twice"}
    frame = spark.createDataFrame([(k, v, 1, "p") for k, v in docs.items()], "source_id string, document string, key int, value string").repartition(3)
    first = {r.source_id: (r.path, json.loads(r.value)) for r in S.first_under(frame, "listResults").collect()}
    found = {k: R.find(decoded(v), "listResults") for k, v in docs.items()}
    assert first == {k: (path, numbers(value)) for k, hit in found.items() if hit for value, path in [hit]}
    objects = {}
    for r in sorted(S.objects_under(frame).collect(), key=lambda r: [(s.i, (s.k or "").encode()) for s in r.place]):
        objects.setdefault(r.source_id, []).append((r.path, json.loads(r.value)))
    assert objects == {k: rows for k, v in docs.items() if (rows := [(c["path"], json.loads(c["raw"], parse_int=int)) for c in plain_candidates(decoded(v))])}
    strings = {r.source_id: r.strings for r in S.strings_below(frame).collect()}
    assert strings == {k: rows for k, v in docs.items() if (rows := R.gather(decoded(v)))}


def plain_candidates(value):
    return [{"path": c["path"], "raw": json.dumps(numbers(at(value, c["path"])))} for c in R.candidates(value)]


def at(value, path):
    rest = path
    while rest:
        rest = rest.lstrip(".")
        if rest.startswith("["):
            index, _, rest = rest[1:].partition("]")
            value = value[int(index)]
        else:
            name = next(n for n in sorted(NAMES, key=len, reverse=True) if rest.startswith(n))
            value, rest = value[name], rest[len(name) :]
    return value


def test_no_python_and_nothing_to_find(spark):
    frame = spark.createDataFrame([("t", '{"a":1,"a":2}'), ("n", None)], "source_id string, document string")
    found = S.values_under(frame, "a")
    assert found.count() == 0 and "Python" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert S.strings_below(frame.limit(0)).count() == 0
