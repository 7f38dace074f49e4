"""Compiled JSON Schemas: paths of first findings, types, nested keys, items, and a plain checker beside them."""

import json
import random
import re

import pytest

from garimpo.operators import schemas, validation

GOOD = {
    "id": "sol-1", "nome": "Nome", "descricao": "Uma descricao longa", "orgao": "Org", "area": "ia", "problema": "Um problema longo", "solucao": "Uma solucao longa", "tecnologias": ["spark", "sql"], "status": "piloto", "sintomas": ["s"], "causa_raiz": "causa", "pre_condicoes": [], "passos_implantacao": ["p"], "riscos": [],
    "conformidade": {"dados_pessoais": "nao", "base_legal_lgpd": "base", "hospedagem": "local", "modelo": "mm", "licenca_modelo": "mit", "dependencias_open_source": ["spark"]},
}


def paths(rows, spark, schema=None, unique=None):
    df = spark.createDataFrame([(i, r if isinstance(r, (str, type(None))) else json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "n int, j string")
    got = schemas.findings(df, schema or validation.catalog_schema(), "j", unique).orderBy("n").collect()
    return [[f.path for f in r.findings] for r in got]


def changed(**fields):
    return GOOD | fields


def nested(**fields):
    return GOOD | {"conformidade": GOOD["conformidade"] | fields}


def test_paths_of_findings(spark):
    cases = [
        (GOOD, []),
        (changed(nome=5), ["nome"]),
        (changed(nome="x"), ["nome"]),
        (changed(tecnologias="spark"), ["tecnologias"]),
        (changed(tecnologias=["ok", 5, "x"]), ["tecnologias.1", "tecnologias.2"]),
        (changed(tecnologias=["a" * 3, "a" * 3]), ["tecnologias"]),
        (changed(area=None), ["area", "area"]),
        (changed(extra=1), ["<raiz>"]),
        (changed(id="UPPER", status="x"), ["id", "status"]),
        (nested(hospedagem="lua"), ["conformidade.hospedagem"]),
        (nested(outro="chave"), ["conformidade"]),
        (nested(modelo=["m"]), ["conformidade.modelo"]),
        (changed(conformidade="sim"), ["conformidade"]),
        ({k: v for k, v in GOOD.items() if k != "riscos"} | {"causa_raiz": "x"}, ["<raiz>", "causa_raiz"]),
        ([GOOD], ["<raiz>"]),
        ("{not json", ["<raiz>"]),
        (None, ["<raiz>"]),
        (changed(descricao="é" * 2001), ["descricao"]),
    ]
    assert paths([c for c, _ in cases], spark) == [want for _, want in cases]


def test_repeated_ids_and_the_first_finding(spark):
    rows = [GOOD, changed(id="sol-2"), changed(id="sol-1", nome="x"), changed(id=7)]
    assert paths(rows, spark, unique="id") == [["id"], [], ["nome", "id"], ["id"]]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "n int, j string")
    assert schemas.checked(df.where("n = 1"), validation.catalog_schema(), "j", "n", "id").count() == 1
    with pytest.raises(Exception, match="invalid at nome: shorter than 3"):
        schemas.checked(df.where("n in (1, 2)"), validation.catalog_schema(), "j", "n", "id").collect()


def plain(schema, value, at=()):
    """The same keywords by recursion, for comparison."""
    out = []
    kinds = {"string": str, "object": dict, "array": list, "null": type(None), "boolean": bool}
    isa = lambda k: (isinstance(value, (int, float)) and not isinstance(value, bool) and (k == "number" or float(value).is_integer())) if k in ("integer", "number") else isinstance(value, kinds[k])
    for key, want in schema.items():
        bad = 0
        if key == "type":
            bad = not any(isa(k) for k in ([want] if isinstance(want, str) else want))
        elif key == "enum":
            bad = not any(type(value) is type(w) and value == w for w in want)
        elif key == "pattern":
            bad = isa("string") and not re.search(want, value)
        elif key in ("minLength", "maxLength"):
            bad = isa("string") and (len(value) < want if key == "minLength" else len(value) > want)
        elif key in ("minimum", "exclusiveMaximum"):
            bad = isa("number") and (value < want if key == "minimum" else value >= want)
        elif key in ("minItems", "maxItems"):
            bad = isa("array") and (len(value) < want if key == "minItems" else len(value) > want)
        elif key == "uniqueItems":
            bad = isa("array") and len({json.dumps(v) for v in value}) < len(value)
        elif key == "required" and isa("object"):
            bad = sum(n not in value for n in want)
        elif key == "additionalProperties" and isa("object"):
            bad = any(n not in schema["properties"] for n in value)
        elif key == "properties" and isa("object"):
            for n, inner in want.items():
                if n in value:
                    out += plain(inner, value[n], (*at, n))
        elif key == "items" and isa("array"):
            for i, v in enumerate(value):
                out += plain(want, v, (*at, f"{i:09d}"))
        out += [at] * int(bad)
    return out


def test_equals_a_plain_checker_on_random_rows(spark):
    schema = {
        "title": "t", "type": "object", "required": ["a", "b"], "additionalProperties": False,
        "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "string", "minLength": 2}, "it's": {"enum": [1, "1", True]}}}}, "c": {"type": "number", "exclusiveMaximum": 4.5}},
    }
    rng = random.Random(2)
    leaf = lambda: rng.choice((None, 1, 2, 7, 4.5, 2.0, "", "ab", "1", True, [], {}))
    item = lambda: rng.choice((leaf(), {"x": rng.choice(("ab", "a", 3))}, {"x": "abc", "it's": rng.choice((1, "1", True, 2, None))}, {"y": 1}))
    rows = [{k: v for k, v in (("a", leaf()), ("b", rng.choice((leaf(), [item() for _ in range(rng.randrange(5))]))), ("c", leaf()), ("d", 1)) if rng.random() < 0.8} for _ in range(150)] + [leaf() for _ in range(10)]
    shown = lambda at: ".".join(str(int(p)) if p.isdigit() and len(p) == 9 else p for p in at) or "<raiz>"
    assert paths([json.dumps(r) for r in rows], spark, schema) == [[shown(p) for p in sorted(plain(schema, r))] for r in rows]


def test_unknown_keywords_refuse(spark):
    with pytest.raises(NotImplementedError, match="oneOf"):
        paths([GOOD], spark, {"oneOf": []})
