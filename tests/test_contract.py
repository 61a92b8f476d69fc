import copy

import pytest

from lodestrata.catalog import CONTRACT
from lodestrata.contract import expand, load, parse_corpus
from lodestrata.errors import ConfigError

SOURCE = {"name": "s", "adapter": "csv", "location": "rows.csv", "mapping": {"post_id": {"from": "id"}}, "provenance": {"source": "x", "media_ref": "m", "timestamp_field": "t"}, "dedupe": {"key": ["post_id"]}}


def changed(path, value):
    raw = copy.deepcopy(CONTRACT) | {"sources": [copy.deepcopy(SOURCE)]}
    at = raw
    for p in path[:-1]:
        at = at[p]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return raw


def test_valid_contract_compiles():
    c = parse_corpus("posts", CONTRACT | {"sources": [SOURCE]}, "/x/corpora/posts.yaml")
    assert c.with_role("metric") == ["value_score"]
    kinds = {f.name: f.dataType.simpleString() for f in c.struct()}
    assert kinds["domains"] == "array<string>" and kinds["value_score"] == "bigint" and kinds["is_promo"] == "boolean"
    assert c.struct()["owner"].metadata["roles"] == ["filter", "facet", "sort"]
    assert c.sources[0].location == "/x/rows.csv"


@pytest.mark.parametrize(
    "path, value",
    [
        (("schema", "schema_version"), 1), (("schema", "schema_version"), ""), (("schema", "id_field"), "nope"), (("schema", "refresh_hash_fields"), ["nope"]),
        (("schema", "fields", "owner", "type"), "geo"), (("schema", "fields", "owner", "role"), "boss"), (("schema", "fields", "owner", "role"), "metric"), (("schema", "fields", "owner", "role"), "passthrough"),
        (("schema", "fields", "summary"), {"type": "object", "role": "search"}), (("schema", "fields", "owner", "weight"), 2), (("schema", "fields", "summary", "weight"), True), (("schema", "fields", "summary", "weight"), -1),
        (("schema", "fields", "summary"), {"type": "date", "example": "someday"}), (("sources",), [3]), (("sources", 0, "name"), ""), (("sources", 0, "adapter"), "ftp"), (("sources", 0, "mapping"), {"nope": {"from": "x"}}),
        (("sources", 0, "mapping"), {"owner": {}}), (("sources", 0, "mapping"), {"owner": {"from": "x", "transform": "magic"}}), (("sources", 0, "provenance", "media_ref"), KeyError),
    ],
)
def test_invalid_contracts_fail(path, value):
    with pytest.raises(ConfigError):
        parse_corpus("posts", changed(path, value), "/x/corpora/posts.yaml")


def test_broken_corpus_does_not_hide_others(tmp_path, monkeypatch):
    import yaml

    (tmp_path / "corpora").mkdir()
    (tmp_path / "corpora/good.yaml").write_text(yaml.safe_dump(CONTRACT))
    (tmp_path / "corpora/bad.yaml").write_text("schema: [")
    (tmp_path / "corpora/odd.yaml").write_text("sources: [7]")
    (tmp_path / "config.yaml").write_text("engine: {default_corpus: good, artifacts_dir: '${OUT_DIR}/a'}")
    monkeypatch.setenv("OUT_DIR", "/tmp/out")
    c = load(tmp_path / "config.yaml")
    assert set(c.corpora) == {"good"} and set(c.errors) == {"bad", "odd"}
    assert c.corpus().name == "good" and str(c.artifacts_dir) == "/tmp/out/a"
    with pytest.raises(ConfigError):
        c.corpus("bad")
    assert expand("${NOT_SET_HERE}/x") == "${NOT_SET_HERE}/x"
