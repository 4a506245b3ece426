import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from syllabica.operators import catalogue as cat
from syllabica.operators import quality as qual
from syllabica.sources import catalogue_files as files
from syllabica.sources import export, markup, tables
from syllabica.sources.json_values import cut_up, values
from syllabica.streaming import jobs, keyed
from tests.conftest import rows


def record(subject, years, **extra):
    return {
        "materia": subject, "cursos_aplicables": years,
        "competencias_especificas": [{"codigo": "CE1", "descripcion": f"uno {years[0]}", "descriptores": ["STEM2"]}],
        "criterios_evaluacion": [{"codigo": "1.1", "competencia": "CE1", "descripcion": "a"}, {"codigo": "2.1", "competencia": "CE2", "descripcion": "b"}],
        "saberes_basicos": [{"codigo": "A", "titulo": "T", "items": ["x", "y"], **extra.pop("saberes", {})}], **extra,
    }


@pytest.fixture()
def folder(tmp_path):
    data = {
        "a__1.json": record("Latín", ["1º ESO"]), "b__2.json": record("Latín", ["2º ESO"]),
        "c__1.json": record("Latín", ["1º ESO"], comunidad="cataluna", idioma="ca", saberes={"codigos_items": ["LAT.1.A.1"]}),
    }
    arrived = tmp_path / "in"
    arrived.mkdir()
    for name, body in data.items():
        (arrived / name).write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return str(arrived)


def test_loading_twice_changes_nothing(spark, folder):
    flat = files.flatten_catalogue(files.read_catalogue(spark, folder, "Andalucía"))
    name = F.regexp_extract("fichero", "[^/]*$", 0)
    assert rows(flat["rechazados"], name, "codigo") == [("a__1.json", "2.1"), ("b__2.json", "2.1"), ("c__1.json", "2.1")]
    first = cat.load_catalogue(flat)
    assert rows(first["competencias"], "comunidad", "cursos_aplicables", "descripcion") == [
        ("andalucia", ["1º ESO", "2º ESO"], "uno 2º ESO"), ("cataluna", ["1º ESO"], "uno 1º ESO")]
    assert rows(first["criterios"], "comunidad", "cursos_aplicables") == [("andalucia", ["1º ESO"]), ("andalucia", ["2º ESO"]), ("cataluna", ["1º ESO"])]
    assert rows(first["saberes"].where("comunidad = 'cataluna'"), "codigo", "descripcion") == [("A.2", "y"), ("LAT.1.A.1", "x")]
    second = cat.load_catalogue(flat, first)
    for name, table in first.items():
        plain = [c for c in table.columns if c not in ("creada", "listada")]
        assert rows(second[name], *plain) == rows(table, *plain)
        assert second[name].where("creada").count() == 0


def test_unknown_region_stops_before_reading(spark):
    with pytest.raises(ValueError):
        files.read_catalogue(spark, "/no/existe", "Atlántida")


def test_empty_folder_loads_nothing(spark, tmp_path):
    flat = files.flatten_catalogue(files.read_catalogue(spark, str(tmp_path)))
    assert cat.load_counts(cat.load_catalogue(flat)["competencias"]).first().asDict() == {"nuevas": 0, "actualizadas": 0}


def test_written_blocks_and_skipped(spark, folder, tmp_path):
    records = files.read_catalogue(spark, folder)
    empty = records.where("fichero LIKE '%a__1.json'").withColumn("criterios_evaluacion", F.array().cast(records.schema["criterios_evaluacion"].dataType))
    skipped = files.write_blocks(records.where("fichero NOT LIKE '%a__1.json'").unionByName(empty), str(tmp_path / "out"))
    assert rows(skipped, "materia", "cursos_aplicables") == [("Latín", ["1º ESO"])]
    back = spark.read.json(str(tmp_path / "out"))
    assert rows(back, "comunidad", "fichero") == [("cataluna", "latin__1"), ("ceuta", "latin__2")]


def test_catalogue_stream_rewrites_touched_buckets_only(spark, folder, tmp_path):
    target, control = str(tmp_path / "t"), str(tmp_path / "c")

    def load():
        jobs.load_files(jobs.catalogue_pieces(spark, folder), target, control).awaitTermination()
        return rows(jobs.loaded(spark, target, "criterios"), "comunidad", "materia", "codigo")

    def files_of(batch):
        return sorted(p.parent.name for p in (tmp_path / "t" / "criterios" / f"version={batch:012d}").glob("*/*.parquet"))

    once = load()
    assert len(once) == 3 and load() == once
    first = files_of(0)
    text = json.dumps(record("Latín", ["3º ESO"])) + '\n{"materia": \n' + json.dumps(record("Griego", ["3º ESO"])) + " sobra"
    (tmp_path / "in" / "d__3.json").write_text(text, encoding="utf-8")
    assert len(load()) == 5
    # one file of two subjects: two buckets at most, the others are not written again
    assert 1 <= len(files_of(1)) <= 2 and files_of(0) == first
    bad = spark.read.parquet(f"{target}/rechazos")
    assert [r[0] for r in rows(bad, "texto")] == ["sobra", '{"materia":']


@pytest.mark.parametrize("text, good, bad", [
    ("", [], []), (" \n", [], []), ('\ufeff{"a": 1}', [{"a": 1}], []), ('{"a": "}{"}{"b": [1]}', [{"a": "}{"}, {"b": [1]}], []),
    ('{"a": 1}\n{"a": 2\n{"a": 3}\n', [{"a": 1}, {"a": 3}], ['{"a": 2']), ('{"a": 1} tail', [{"a": 1}], ["tail"]),
    ('{\n  "a": {\n    "b": 1\n  },\n}\n{\n "c": 2\n}', [{"c": 2}], ['{\n  "a": {\n    "b": 1\n  },\n}']),
    ('[{"a": 1}, 3, {"b": NaN}]', [], ['[{"a": 1}, 3, {"b": NaN}]']), ('[{"a": 1}, 3, "x", {"b": 2}]', [{"a": 1}, {"b": 2}], ["3", '"x"']),
    ("null", [], ["null"]), ("[" * 100_000, [], ["[" * 100_000]), ('{"a": 1}' * 3, [{"a": 1}] * 3, []), ("[]", [], []),
])
def test_values_of_a_text(text, good, bad):
    found = list(values(text))
    assert [json.loads(t) for t, ok in found if ok] == good
    assert [t for t, ok in found if not ok] == bad


def _stream(spark, tmp_path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


TASK = "id_tarea string, id_situacion bigint, ts timestamp, event string, section string"


def test_task_states_expire(spark, tmp_path):
    def add(*events):
        df = spark.createDataFrame([(t, 1, datetime.fromisoformat(f"2024-01-01 {at}"), e, s) for t, at, e, s in events], TASK)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, keys=("id_tarea",)):
        stream = make(_stream(spark, tmp_path, TASK))
        target = str(tmp_path / make.__name__)
        jobs.run_changes(stream, list(keys), target, target + "-control", buckets=4).awaitTermination()
        return keyed.newest(spark, target, stream.schema)

    def task_states(events):
        return jobs.task_states(events, "1 minute", 3_600_000)

    def verdicts(events):
        return jobs.failure_verdicts(events, 2, "1 minute", 3_600_000)

    add(("a", "10:00", "PROGRESO", "x"), ("a", "10:01", "SUCCESS", None), ("b", "10:00", "ERROR", "x"), ("b", "10:02", "ERROR", "y"))
    assert rows(run(task_states), "id_tarea", "event", "final") == [("a", "SUCCESS", True), ("b", "ERROR", False)]
    assert rows(run(verdicts), "id_tarea", "fallos", "veredicto") == [("b", 2, "provisional")]
    # progress after success changes nothing; the third error is one too many
    add(("a", "10:05", "PROGRESO", "z"), ("b", "10:06", "ERROR", "z"))
    assert rows(run(task_states), "id_tarea", "event", "section") == [("a", "SUCCESS", ""), ("b", "ERROR", "z")]
    assert rows(run(verdicts), "id_tarea", "fallos", "veredicto") == [("b", 3, "definitivo")]
    # a day later the states of both are forgotten, and what the table holds stays
    for hour in ("20:00", "21:00"):
        add(("c", hour, "PROGRESO", "x"))
        assert [r[0] for r in rows(run(task_states), "id_tarea")] == ["a", "b", "c"]
    state = spark.read.format("statestore").load(str(tmp_path / "task_states-control"))
    assert [r["key"]["id_tarea"] for r in state.collect()] == ["c"]
    # the last batch wrote the one bucket of c
    last = sorted((tmp_path / "task_states").glob("version=*"))[-1]
    assert len(list(last.glob("cubo=*"))) == 1


def test_steps_get_few_columns_and_plain_values(spark, monkeypatch):
    """What Spark turns into pandas for each task: its key, the time of the watermark and one array."""
    given = {}
    made = GroupedData.applyInPandasWithState

    def keep(grouped, step, *rest):
        given[step.__qualname__.split(".")[0]] = (grouped._df.columns, step)
        return made(grouped, step, *rest)

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", keep)
    source = spark.readStream.format("rate").load()
    events = source.select(F.lit("a").alias("id_tarea"), F.lit(1).cast("bigint").alias("id_situacion"), F.col("timestamp").alias("ts"),
                           F.lit("ERROR").alias("event"), F.lit(None).cast("string").alias("section"), F.lit("x").alias("otra"))
    assert jobs.task_states(events).schema["ts"].dataType.simpleString() == "timestamp"
    jobs.failure_verdicts(events)
    assert {n: c for n, (c, _) in given.items()} == dict.fromkeys(("task_states", "failure_verdicts"), ["id_tarea", "id_situacion", "ts", "valor"])

    class State:
        hasTimedOut, exists, kept = False, False, None

        def update(self, value):
            self.kept = value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

    no_time = str(-(1 << 63))
    frame = lambda *v: iter([pd.DataFrame({"valor": [np.array(x, object) for x in v]})])
    states, verdicts, state = given["task_states"][1], given["failure_verdicts"][1], State()
    found = list(states(("a", 1), frame((no_time, "PROGRESO", ""), ("5000", None, "s"), ("3000", "SUCCESS", "t")), state))
    assert [f.iloc[0].tolist() for f in found] == [["a", 1, "SUCCESS", "t", 3000, True]] and state.kept == (True, 3000, "SUCCESS", "t")
    assert state.at == 86_400_005
    assert [f.iloc[0].tolist() for f in states(("a", None), frame((no_time, "PROGRESO", "")), State())] == [["a", None, "PROGRESO", "", None, False]]
    found = list(verdicts(("a", 1), frame(("5000", "ERROR"), (no_time, None), ("1000", "ERROR"), ("2000", "ERROR")), state))
    assert [f.iloc[0].tolist() for f in found] == [["a", 1, 3, "definitivo"]] and state.kept == (3, False, 5000)


def test_equal_requests_pass_again_after_the_watermark(spark, tmp_path):
    schema = "id_situacion bigint, seccion string, ts timestamp, idioma string, texto string"
    out = []
    for hour in ("10:00", "10:30", "15:00", "20:00"):
        df = spark.createDataFrame([(1, "s", datetime.fromisoformat(f"2024-01-01 {hour}"), "es", "t")], schema)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.distinct_requests(_stream(spark, tmp_path, schema), "1 hour")
        jobs.run_append(stream, str(tmp_path / "out"), str(tmp_path / "control")).awaitTermination()
        out.append(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).count())
    # a batch sees the watermark of the events before it: the request of 15:00 still meets that of 10:00
    assert out == [1, 1, 1, 2]


def test_xml_paragraphs(spark):
    xml = '<d><texto><p class="a">Uno &amp; <i>dos</i></p><p> </p><p>Tres</p></texto><p class="z">fuera</p></d>'
    df = spark.createDataFrame([("d", xml)], "doc_id string, raw string")
    assert rows(markup.paragraphs_from_xml(df), "cls", "text") == [("", "Tres"), ("a", "Uno &  dos")]


def test_escaped_html(spark):
    html = "&lt;p&gt;a) Aranès&lt;br /&gt;b) Francès &amp;amp; més&lt;/p&gt;&lt;p&gt; &lt;/p&gt;"
    xml = f'<act><hcontainer><heading>Títol  u</heading><content period="{html}"/></hcontainer><hcontainer><heading>Dos</heading></hcontainer></act>'
    df = spark.createDataFrame([("d", xml)], "doc_id string, raw string")
    got = markup.paragraphs_from_escaped_html(df).orderBy("seq")
    assert [(r.cls, r.text) for r in got.collect()] == [
        ("akn_heading", "Títol u"), ("akn_p", "a) Aranès"), ("akn_p", "b) Francès & més"), ("akn_heading", "Dos")]


@pytest.mark.parametrize("html, text", [
    ("<p>Uno</p><p>Dos</p>", "Uno\nDos"), ("<p>a<button>no</button>b</p><script>x</script>", "ab"), ("<p hidden>no</p><span aria-hidden='true'>no</span>sí", "sí"),
    ("<table><thead><tr><th>C</th><th>N</th></tr></thead><tbody><tr><td>CE1</td><td>Alto</td></tr><tr><td></td><td>Bajo</td></tr></tbody></table>",
     "C: CE1. N: Alto\nN: Bajo"),
    ("<table><tr><td>a</td><td>b</td></tr></table>", "a. b"), ("<p>Fin. . Otra &amp; más</p>", "Fin. Otra & más"),
    ("<div class='seccion-gen__acciones'>no<div>no</div></div>x<br>y", "x\ny"),
])
def test_readable_text(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert markup.readable_text(df).first()["lectura"] == text


def test_knowledge_of_escaped_query_matches_brute_force(spark):
    """The escaped-paragraph query, counted in plain Python on a small table."""
    import __spark_entry__ as entry

    got = {(r.doc_id, r.cls): r.parrafos for r in entry.queries()["escaped_paragraphs"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc, text in texts:
        want[(doc, "akn_heading")] = 1
        n = sum(1 for line in text.split("\n") if line.strip())
        if n:
            want[(doc, "akn_p")] = n
    assert got == want


def test_export_hides_the_other_adaptation(spark):
    content = '{"atencion_diversidad":{"ajustes_no_significativos":["n"],"ajustes_significativos":["s"]},"conexion_curricular":{}}'
    df = spark.createDataFrame([(1, "significativa", content), (2, "no_significativa", content), (3, None, content)], "id_situacion int, tipo_adaptacion string, contenido string")
    got = rows(export.export_rows(df).where("seccion = 'atencion_diversidad'"), "id_situacion", "valor")
    assert got == [(1, "s"), (2, "n"), (3, "n"), (3, "s")]


def test_artefacts_and_translations(spark, tmp_path):
    (tmp_path / "7").mkdir()
    (tmp_path / "7" / "objetivos-0123456789abcdef.mp3").write_bytes(b"x")
    (tmp_path / "7" / "otra.txt").write_bytes(b"x")
    assert rows(tables.artefact_inventory(spark, str(tmp_path)), "id_situacion", "seccion", "huella", "extension") == [
        (7, "objetivos", "0123456789abcdef", "mp3")]
    names = spark.createDataFrame([("/a/7/objetivos-0123456789abcdef.mp3",), ("/a/7/otra.txt",), (None,)], "path string")
    assert rows(tables.unnamed_artefacts(names)) == [("/a/7/otra.txt",), (None,)]
    plural = tmp_path / "plural" / "pt_BR"
    plural.mkdir(parents=True)
    (plural / "messages.po").write_text('msgid "un dia"\nmsgid_plural "%d dies"\nmsgstr[0] "um dia"\nmsgstr[1] "%d dias"\n', encoding="utf-8")
    forms = tables.read_translations(spark, str(tmp_path / "plural")).first()
    assert (forms.lang, forms.msgstr, forms.formas) == ("pt_BR", "um dia", ["um dia", "%d dias"])
    po = tmp_path / "po" / "ca" / "LC_MESSAGES"
    po.mkdir(parents=True)
    (po / "messages.po").write_text(
        'msgid ""\nmsgstr ""\n"Language: ca\\n"\n\n#: a\nmsgid "Saberes básicos"\nmsgstr "Sabers bàsics"\n\n#, fuzzy\nmsgid ""\n"Hola "\n"mundo"\nmsgstr ""\n"Hola \\"món\\""\n\n'
        'msgid "Sin"\nmsgstr ""\n\n#~ msgid "vieja"\n#~ msgstr "x"\n', encoding="utf-8")
    got = tables.read_translations(spark, str(tmp_path / "po"))
    assert rows(got, "lang", "msgid", "msgstr", "fuzzy") == [("ca", "Hola mundo", 'Hola "món"', True), ("ca", "Saberes básicos", "Sabers bàsics", False), ("ca", "Sin", "", False)]
    terms = spark.createDataFrame([("ca", "Saberes básicos", "Sabers")], "lang string, msgid string, oficial string")
    assert qual.translation_report(got, terms, {"ca": "hola "}).first().asDict() == {
        "lang": "ca", "mensajes": 3, "sin_traducir": 1, "dudosas": 1, "terminos": 1, "separador": 1}


def test_dry_run_writes_nothing(spark, tmp_path):
    df = spark.range(3)
    assert tables.apply_or_report(df, None) is df and list(tmp_path.iterdir()) == []
    assert tables.apply_or_report(df, str(tmp_path)).count() == 3


def test_files_read_as_documents(spark, tmp_path):
    (tmp_path / "uno.xml").write_text("<d><texto><p class='a'>Uno\nmás</p></texto></d>", encoding="utf-8")
    docs = markup.read_documents(spark, str(tmp_path))
    assert rows(markup.paragraphs_from_xml(docs), "doc_id", "cls", "text") == [("uno.xml", "a", "Uno\nmás")]


def test_valid_and_rejected_rows(spark):
    df = spark.createDataFrame(
        [(1, "Bien", 5, "es"), (2, " x ", 0, "de"), (3, None, 200, "ca")], "id int, titulo string, num_sesiones int, idioma string")
    good, bad = qual.split_valid(df)
    assert rows(good, "id") == [(1,)]
    assert rows(bad, "id", "motivos") == [(2, ["titulo:corto", "num_sesiones:rango", "idioma:valor"]), (3, ["titulo:falta"])]


def test_sorted_equality(spark):
    from syllabica.functions.text import same_members

    df = spark.createDataFrame([(["b", "a"], ["a", "b"], ["a"])], "x array<string>, y array<string>, z array<string>")
    assert df.select(same_members(F.col("x"), F.col("y")), same_members(F.col("x"), F.col("z"))).first() == (True, False)


def test_state_is_written_beside_the_old_one(spark, tmp_path):
    first = tables.write_new_state(spark.range(2), str(tmp_path))
    second = tables.write_new_state(spark.range(3), str(tmp_path))
    assert first != second and tables.read_table(spark, first, "id").count() == 2


def test_staged_tables_are_joined_by_sorting(spark):
    """Compressed files say little of the size of their rows; such a table must not be sent whole to the driver."""
    staged = tables.cut_lineage(spark.range(100), "prueba")
    plan = spark.range(5).join(staged.groupBy("id").count(), "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_records_of_one_name_are_many_files(spark, tmp_path):
    blocks = spark.range(2500).coalesce(1).select(
        F.lit("galicia").alias("comunidad"), F.lit("Música").alias("materia"), F.array(F.lit("1º ESO")).alias("cursos_aplicables"),
        F.array(F.struct(F.col("id").cast("string").alias("codigo"), F.lit("CE1").alias("competencia"), F.lit("x").alias("descripcion"))).alias("criterios_evaluacion"))
    files.write_blocks(blocks, str(tmp_path / "json"))
    written = list((tmp_path / "json").rglob("*.json"))
    assert len(written) == 3 and max(len(p.read_text().splitlines()) for p in written) == 1000
    assert files.read_catalogue(spark, str(tmp_path / "json")).select(F.explode("criterios_evaluacion.codigo").alias("c")).distinct().count() == 2500


def test_values_of_a_long_text_go_out_in_parts(spark):
    df = spark.createDataFrame([('{"a": 1} ' * 25_000, "f"), ("x", "g"), (None, "h")], "value string, ruta string").coalesce(1)
    got = cut_up(df).groupBy("ruta", "bueno").agg(F.count("*").alias("n"), F.min("n").alias("a"), F.max("n").alias("z"))
    assert rows(got) == [("f", True, 25_000, 0, 24_999), ("g", False, 1, 0, 0)]
