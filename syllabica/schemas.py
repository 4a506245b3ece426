"""DDL schemas of the records read from files and streams."""

CATALOGUE_FILE = """
    materia STRING, materia_oficial STRING, etapa STRING, ciclo STRING, itinerario STRING,
    cursos_aplicables ARRAY<STRING>, comunidad STRING, idioma STRING,
    competencias_especificas ARRAY<STRUCT<codigo: STRING, descripcion: STRING, descriptores: ARRAY<STRING>>>,
    criterios_evaluacion ARRAY<STRUCT<codigo: STRING, competencia: STRING, descripcion: STRING>>,
    saberes_basicos ARRAY<STRUCT<codigo: STRING, bloque: STRING, titulo: STRING, items: ARRAY<STRING>,
                                 codigos_items: ARRAY<STRING>>>
"""

PARAGRAPH = "doc_id STRING, seq BIGINT, cls STRING, text STRING"

POSITIONED_LINE = """
    doc_id STRING, seq BIGINT, page INT, x DOUBLE, y DOUBLE, size DOUBLE,
    bold BOOLEAN, in_table BOOLEAN, text STRING
"""

TABLE_CELL = "doc_id STRING, page INT, table_no INT, row INT, col INT, n_cols INT, text STRING"

TASK_EVENT = "id_situacion BIGINT, ts TIMESTAMP, attempt INT, event STRING, section STRING"

TRANSLATION = "lang STRING, msgid STRING, msgstr STRING, fuzzy BOOLEAN"
