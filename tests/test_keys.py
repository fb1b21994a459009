"""Values that name their key: envelopes, several keys and modes at once, rotation, configs on file."""

import re

import pytest

from spanveil import Encrypt, Hash, Mask, Pseudonym, Redact, Replace, anonymize, deanonymize, reseal
from spanveil.sources import configs

OLD, NEW, B64 = "0123456789abcdef", "f" * 32, "c2l4dGVlbiBieXRlcyAhIQ=="
TEXT = "Emma met Noah in Rome; Emma left."
SPANS = [("PERSON", 0, 4, 1.0), ("PERSON", 9, 13, 1.0), ("PLACE", 17, 21, 1.0), ("PERSON", 23, 27, 1.0)]


def given(spark, text=TEXT, spans=SPANS, n=3):
    kind = "id long, text string, spans array<struct<entity_type string, start int, end int, score double>>"
    return spark.createDataFrame([(k, text, spans) for k in range(n)] + [(90, None, spans), (91, text, None), (92, "", [])], kind)


def values(df, col="anonymized_text"):
    return [r[col] for r in df.orderBy("id").collect()]


def test_envelope_names_key_mode_and_form(spark):
    ops = {"PERSON": Encrypt(OLD, key_id="k-1"), "PLACE": Encrypt(B64, "GCM", True, key_id="g_2")}
    done = anonymize(given(spark), ops, id_col="id")
    text = done.where("id = 0").first().anonymized_text
    assert re.fullmatch(r"sv1\.k-1\.CBC\.text\.[A-Za-z0-9+/=]+ met sv1\.k-1\.CBC\.text\.\S+ in sv1\.g_2\.GCM\.base64\.\S+; sv1\.k-1\.CBC\.text\.\S+ left\.", text)
    opened = deanonymize(done, key_table={"k-1": OLD, "g_2": B64})
    assert values(opened, "restored_text") == [TEXT] * 3 + [None, None, ""]
    assert [r.status for r in opened.orderBy("id").collect()] == ["ok"] * 3 + ["missing_text", "missing_text", "ok"]
    some = deanonymize(done, key_table={"k-1": OLD}).where("id = 0").first()
    assert some.status == "missing_key" and some.restored_text.startswith("Emma met Noah in sv1.g_2")
    wrong = deanonymize(done, key_table={"k-1": OLD, "g_2": OLD}).where("id = 0").first()
    assert wrong.status == "bad_key"
    for bad in ("", "a b", "x" * 65, "a.b"):
        with pytest.raises(ValueError):
            Encrypt(OLD, key_id=bad)


def test_old_and_new_values_side_by_side(spark):
    """Values without an envelope are opened by the key of their type, each in its own mode."""
    ops = {"PERSON": Encrypt(OLD, "GCM"), "PLACE": Encrypt(NEW, key_id="n")}
    done = anonymize(given(spark), ops, id_col="id")
    opened = deanonymize(done, {"PERSON": Encrypt(OLD, "GCM")}, key_table={"n": NEW})
    assert values(opened, "restored_text") == [TEXT] * 3 + [None, None, ""]
    both = anonymize(given(spark), {"PERSON": Encrypt(OLD, "GCM"), "PLACE": Encrypt(NEW)}, id_col="id")
    opened = deanonymize(both, {"PERSON": Encrypt(OLD, "GCM"), "PLACE": NEW})
    assert values(opened, "restored_text") == [TEXT] * 3 + [None, None, ""]


@pytest.mark.parametrize("key_id", [None, "old"])
def test_rotation(spark, key_id):
    ops = {"PERSON": Encrypt(OLD, key_id=key_id), "PLACE": Mask("*", 2)}
    done = anonymize(given(spark), ops, id_col="id")
    new = Encrypt(NEW, "GCM", key_id="new")
    moved = reseal(done, new, {"old": OLD}, {"PERSON": OLD} if key_id is None else None, id_col="id")
    first = moved.where("id = 0").first()
    assert first.status == "ok" and first.anonymized_text.count("sv1.new.GCM.text.") == 3
    assert all(first.anonymized_text[i.start : i.end] == i.text for i in first["items"])
    assert {(i.operator, i.entity_type) for i in first["items"]} == {("encrypt", "PERSON"), ("mask", "PLACE")}
    opened = deanonymize(moved, key_table={"new": NEW})
    assert values(opened, "restored_text") == [TEXT.replace("Rome", "**me")] * 3 + [None, None, ""]
    # once more: nothing changes; with a wrong key: nothing is lost
    again = reseal(moved, new, {"old": OLD}, id_col="id")
    assert values(again) == values(moved)
    lost = reseal(done, new, {"old": NEW}, {"PERSON": NEW} if key_id is None else None, id_col="id").where("id = 0").first()
    assert lost.status == "bad_key" and lost.anonymized_text == done.where("id = 0").first().anonymized_text
    assert {i.operator for i in lost["items"]} == {"encrypt", "mask"}
    with pytest.raises(ValueError):
        reseal(done, Encrypt(NEW), {"old": OLD})


def test_key_table_as_rows(spark):
    done = anonymize(given(spark), {"DEFAULT": Encrypt(OLD, key_id="a")}, id_col="id")
    rows = spark.createDataFrame([("a", OLD), ("a", OLD), ("b", NEW), (None, NEW), ("c", None)], "key_id string, key string")
    assert values(deanonymize(done, key_table=rows), "restored_text")[:3] == [TEXT] * 3
    with pytest.raises(Exception, match="more than one key"):
        deanonymize(done, key_table=rows.union(spark.createDataFrame([("a", NEW)], rows.schema))).collect()
    plan = deanonymize(done, key_table={"a": OLD})._jdf.queryExecution().toString()
    assert OLD not in plan


def test_config_file_keeps_everything(spark, tmp_path):
    config = {
        "A": Encrypt(B64, "GCM", True), "B": Encrypt(OLD, key_id="b"), "C": Pseudonym("salt"), "D": Mask("#", 3, True), "E": Hash("md5"),
        "F": Redact(), "G": Replace("g"), "H": Replace(),
    }
    path = str(tmp_path / "c")
    configs.write_operator_config(spark, config, path)
    table = configs.read_operator_config(spark, path)
    assert configs.load_operators(table) == config
    shown = {r.entity_type: r for r in configs.show_config(table).collect()}
    assert shown["C"].salt == shown["A"].key == "***"
    spans = [(e, 4 * k, 4 * k + 3, 1.0) for k, e in enumerate(config)]
    df = given(spark, "abc " * len(config), spans, 1)
    assert values(anonymize(df, table, id_col="id")) == values(anonymize(df, config, id_col="id"))
    sealed = anonymize(df, table, id_col="id")
    keys = str(tmp_path / "k")
    configs.write_operator_config(spark, {k: config[k] for k in "A"}, keys, decrypt=True)
    opened = deanonymize(sealed, configs.read_operator_config(spark, keys), key_table={"b": OLD}).first()
    assert opened.status == "ok" and opened.restored_text.startswith("abc abc <C_")
    with pytest.raises(ValueError):
        configs.operator_lines({"E": Hash()}, decrypt=True)


def test_lines_that_cannot_be_carried_out(spark):
    rows = [
        ("PERSON", "encrypt", "short", None, None), ("PLACE", "pseudonym", None, None, None), ("X", "custom", None, None, None),
        ("Y", "encrypt", OLD, "ECB", None), ("Z", "redact", None, None, None),
    ]
    table = spark.createDataFrame(rows, "entity_type string, type string, key string, mode string, salt string")
    for entity, bad in (("PERSON", True), ("PLACE", True), ("X", True), ("Y", True), ("Z", False), ("OTHER", False)):
        row = anonymize(given(spark, "abc", [(entity, 0, 3, 1.0)], 1), table, id_col="id").where("id = 0").first()
        assert row.status == ("bad_operator" if bad else "ok")
        assert row.anonymized_text == ("" if entity == "Z" else f"<{entity}>")
