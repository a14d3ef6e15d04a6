"""Legal titles, statements, marked texts and histories derived from the driver tables by SQL that Spark and DuckDB both run;
the generating columns let the oracle rebuild the answer without parsing."""

from __future__ import annotations

_MONTHS = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
_MONTH = "CASE k % 12 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MONTHS)) + " END"

LEGAL = f"""
SELECT *, ty || ' n° ' || num || ' du ' || CAST(k % 28 + 1 AS STRING) || ' ' || {_MONTH} || ' ' || CAST(1960 + k % 60 AS STRING) ||
  CASE k % 5 WHEN 0 THEN ' abrogeant l''article 3 de la Loi n° ' || tnum WHEN 1 THEN ' modifiant le Décret n° ' || tnum
  WHEN 2 THEN ' abrogeant la Loi n° ' || tnum WHEN 3 THEN ' complétant le Décret n° ' || tnum ELSE ' portant mesures fiscales' END AS title
FROM (SELECT k, CAST(k AS STRING) AS document_id, k AS ord,
  CASE k % 6 WHEN 0 THEN 'Loi' WHEN 1 THEN 'Décret' WHEN 2 THEN 'Ordonnance-loi' WHEN 3 THEN 'Arrêté ministériel' WHEN 4 THEN 'Loi organique' ELSE 'Circulaire' END AS ty,
  CAST(k % 500 AS STRING) || '/0' || CAST(k % 9 + 1 AS STRING) AS num, CAST(k % 500 AS STRING) || '/' || CAST(k % 9 + 1 AS STRING) AS nkey,
  CAST(1960 + k % 60 AS STRING) || '-' || lpad(CAST(k % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(k % 28 + 1 AS STRING), 2, '0') AS iso,
  CASE k % 5 WHEN 0 THEN 'REPEALS' WHEN 1 THEN 'MODIFIES' WHEN 2 THEN 'REPEALS' WHEN 3 THEN 'COMPLEMENTS' END AS rel,
  CASE k % 5 WHEN 0 THEN 'Loi' WHEN 1 THEN 'Décret' WHEN 2 THEN 'Loi' WHEN 3 THEN 'Décret' END AS tty,
  CAST((k * 7) % 600 AS STRING) || '/0' || CAST(k % 7 + 1 AS STRING) AS tnum, CAST((k * 7) % 600 AS STRING) || '/' || CAST(k % 7 + 1 AS STRING) AS tkey,
  k % 5 = 0 AS tpartial, 'Source ' || CAST(k % 4 AS STRING) AS source_label, CASE WHEN k % 97 = 0 THEN 'remplacé' ELSE '' END AS superseded_note,
  CASE WHEN k % 41 = 0 THEN 'error' ELSE 'ready' END AS status, k % 43 <> 0 AS present
  FROM (SELECT o_orderkey AS k FROM {{orders}}) AS o) AS t"""

STATEMENTS = """
SELECT *, CASE k % 4 WHEN 0 THEN 'L''article ' || a || ' de la Loi n° ' || tnum || ' est modifié.'
  WHEN 1 THEN 'Texte (abrogé par l''article ' || a || ' du Décret n° ' || tnum || ').'
  WHEN 2 THEN 'Il est inséré au Décret n° ' || tnum || ' les articles ' || a || 'bis, ' || a || 'ter et ' || a || 'quater.'
  ELSE 'Texte sans renvoi à l''article ' || a || '.' END AS content
FROM (SELECT o_orderkey AS k, o_orderkey AS ord, CAST(o_orderkey % 1000 AS STRING) AS document_id, CAST(o_orderkey % 40 + 1 AS STRING) AS article_number, CAST(o_orderkey % 30 + 1 AS STRING) AS a,
  CAST((o_orderkey * 7) % 600 AS STRING) || '/0' || CAST(o_orderkey % 7 + 1 AS STRING) AS tnum, CAST((o_orderkey * 7) % 600 AS STRING) || '/' || CAST(o_orderkey % 7 + 1 AS STRING) AS tkey,
  CASE o_orderkey % 4 WHEN 0 THEN 'MODIFIES' WHEN 1 THEN 'REPEALS' WHEN 2 THEN 'INSERTS' END AS rel, CASE o_orderkey % 4 WHEN 0 THEN 'Loi' WHEN 1 THEN 'Décret' WHEN 2 THEN 'Décret' END AS tty
  FROM {orders}) AS t"""

# Documents 0 to 999 and the instrument that each is; every fifth is none.
OWN = """
SELECT DISTINCT CAST(o_orderkey % 1000 AS STRING) AS document_id, CASE WHEN o_orderkey % 1000 % 5 = 4 THEN NULL WHEN o_orderkey % 1000 % 2 = 0 THEN 'Loi' ELSE 'Décret' END AS instrument_type,
  CASE WHEN o_orderkey % 1000 % 5 = 4 THEN NULL ELSE CAST(o_orderkey % 1000 % 600 AS STRING) || '/' || CAST(o_orderkey % 1000 % 7 + 1 AS STRING) END AS number_key FROM {orders}"""

MARKED = """
SELECT CAST(o_orderkey AS STRING) AS document_id, CAST(o_orderkey % 90 + 1 AS STRING) AS a,
  'en-tête' || {nl} || '## Page 1' || {nl} || 'Préambule du texte. Article ' || CAST(o_orderkey % 90 + 1 AS STRING) || ' : premier texte.' || {nl} || '## Page 2' || {nl} || 'suite du texte.' || {nl} || '## Page 3' || {nl} || 'ANNEXES' || {nl} || 'Tableau.' AS text
FROM {orders}"""

CHAINS = """
SELECT CAST(o_orderkey AS STRING) AS document_id, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 1000 = 999 THEN 'missing'
  WHEN o_orderkey % 1000 = 501 THEN CAST(o_orderkey + 1 AS STRING) WHEN o_orderkey % 10 IN (1, 2, 3) THEN CAST(o_orderkey - 1 AS STRING) ELSE NULL END AS duplicate_of FROM {orders}"""

MESSAGES = """
SELECT conv_id AS conversation_id, turn AS message_id, role, text AS content,
  CASE WHEN role = 'assistant' THEN '[{{"document_id":"d' || CAST(turn % 3 AS STRING) || '","title":"t' || CAST(turn AS STRING) || '","pdf_url":"u"}},{{"document_id":"d' || CAST((turn + 1) % 4 AS STRING) || '","title":"s","pdf_url":"u"}}]' END AS citations_json
FROM {conversations}"""
