"""Facts that the operators of code take (names, numbers, imports, tests, files), derived from the relational tables.

Each is one SELECT that Spark and DuckDB read alike; tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from gaugeworks.plans.adapters import table


def facts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", sql))
    # All braces but those of tables are doubled, as the formatter wants them.
    ready = re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(ready, **{t: table(spark, sf_dir, t) for t in names})


def plain(sql: str) -> str:
    """The SELECT with bare table names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def either(column: str, values: list[str]) -> str:
    """A CASE that picks a text by a number modulo the count of texts."""
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


def words_sql(column: str, words: list[str]) -> str:
    """Whether a text has one of the words as a part, in DuckDB."""
    return "(" + " OR ".join("contains({}, '{}')".format(column, w.replace("'", "''")) for w in words) + ")"


_A, _B = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_CAP_B = f"upper(substr({_B}, 1, 1)) || substr({_B}, 2)"
NAMES = f"""
SELECT p_brand AS repo_id, p_partkey AS part_id, CASE p_size % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'variable' END AS kind, p_partkey % 2 = 0 AS exported,
CASE p_partkey % 9 WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN {_A} || {_CAP_B} WHEN 2 THEN upper(substr(p_name, 1, 1)) || substr({_A}, 2) || {_CAP_B}
  WHEN 3 THEN upper(replace(p_name, ' ', '_')) WHEN 4 THEN replace(p_name, ' ', '_') || '_X' WHEN 5 THEN 'ID' WHEN 6 THEN substr(p_name, 1, 1)
  WHEN 7 THEN '__' || {_A} || '__' ELSE 'Test_' || replace(p_name, ' ', '_') END AS name
FROM {{part}}"""
NUMBERS = """
SELECT l_returnflag AS repo_id, CASE l_suppkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'typescript' END AS language,
CASE l_linenumber WHEN 1 THEN '0' WHEN 2 THEN '1.0' WHEN 3 THEN '-1' WHEN 4 THEN '100' WHEN 5 THEN '2' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS value,
l_linestatus = 'O' AS in_const, CASE WHEN l_partkey % 4 = 0 THEN 'MAX_SIZE' WHEN l_partkey % 4 = 1 THEN NULL ELSE 'size' END AS target, l_partkey % 5 = 0 AS subscript, CAST(l_quantity AS INT) AS code_lines
FROM {lineitem}"""
_GO = ["net/http", "fmt", "github.com/x/sqlx", "os/exec", "github.com/x/cli", "strings"]
_PY = ["requests.adapters", "os", "http.client", "json", "boto3", "re"]
_TS = ["./http", "@aws/sdk/client", "axios", "fs/promises", "react", "node-fetch"]
IMPORTS = f"""
SELECT o_orderpriority AS repo_id, 'f' || CAST(o_custkey AS STRING) AS file, CASE o_custkey % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'python' ELSE 'typescript' END AS language,
CASE o_custkey % 3 WHEN 0 THEN {either("o_orderkey", _GO)} WHEN 1 THEN {either("o_orderkey", _PY)} ELSE {either("o_orderkey", _TS)} END AS module
FROM {{orders}}"""
TESTS = """
SELECT o_orderpriority AS repo_id, 'f' || CAST(o_custkey * 2 AS STRING) AS file, 'Test' || CAST(o_orderkey AS STRING) AS name, CAST(o_orderkey % 400 AS INT) AS line, CAST(o_orderkey * 7 % 6 AS INT) AS assertions
FROM {orders}"""
#: A listing of files: some well-known ones, code in folders, settings.
_PATHS = [
    "README.md", "go.mod", "a.go", "x/b.go", "tsconfig.json", "package.json", "setup.cfg", "pyproject.toml", "mypy.ini", "docs/er_model.svg",
    "docs/notes.md", "examples/run.py", "examples/deep/run.py", "example/other.ts", "CHANGELOG.md", "HISTORY.md", ".github/CONTRIBUTING.md", "CONTRIBUTING",
    "x/class_flow.png", "src/vendor/k.go", "src/m_test.go", "src/tool/go.mod", "src/tool/cmd/main.go", "web/app.spec.tsx", "web/app.ts", "web/__tests__/t.ts", "pkg/test_io.py", "pkg/_hidden.py",
]
_TEXTS = [
    "{\"compilerOptions\": {\"strict\": true}}", "{\"compilerOptions\": {\"strictNullChecks\": true, \"noImplicitAny\": true, \"strictFunctionTypes\": true}}",
    "{ /* notes */ \"compilerOptions\": {\"strict\": true}}", "{\"devDependencies\": {\"typescript\": \"5\"}}", "[mypy]", "[tool.pyright]",
    "module example.com/team/tool", "// Code generated by gen. DO NOT EDIT.\npackage x", "```go\nx := 1\n```\ntext\n```mermaid\na --> b\n```", "{\"dependencies\": {\"react\": \"19\"}, \"compilerOptions\": {\"strictNullChecks\": true}}", "",
]
LISTING = f"""
SELECT 'c' || CAST(o_custkey AS STRING) AS repo_id, {either("o_orderkey", _PATHS)} AS rel_path, min({either("(o_orderkey * 5 + o_custkey)", _TEXTS)}) AS content
FROM {{orders}} GROUP BY o_custkey, {either("o_orderkey", _PATHS)}"""
#: Documents as source files: their text under lines of code whose number follows from the doc_id.
_CODE = "repeat('func Handle' || CAST(doc_id % 7 AS STRING) || '_x() {' || chr(10), CAST(doc_id % 6 AS INT)) || repeat('def load_items_fast(a):' || chr(10), CAST(doc_id % 3 AS INT)) || repeat('export class ViewModel {' || chr(10), CAST(doc_id % 2 AS INT)) || repeat('// if a note' || chr(10), CAST(doc_id % 5 AS INT)) || repeat('/* for x */ case y else' || chr(10), CAST(doc_id % 4 AS INT)) || repeat('import os from ''b''' || chr(10), CAST(doc_id % 8 AS INT)) || repeat('x' || chr(10), CAST(doc_id % 41 AS INT))"
FILES = f"""
SELECT source AS repo_id, 'd' || CAST(doc_id AS STRING) AS file_path, CASE lang WHEN 'en' THEN 'go' WHEN 'de' THEN 'python' WHEN 'fr' THEN 'typescript' ELSE 'other' END AS language,
CASE WHEN doc_id % 9 = 0 THEN 'test' ELSE 'source' END AS class, {_CODE} || coalesce(text, '') AS content,
CAST(length({_CODE} || coalesce(text, '')) - length(replace({_CODE} || coalesce(text, ''), chr(10), '')) + 1 AS INT) AS lines
FROM {{documents}}"""
_SAID = [
    " It returns the sum and handles an error when x is null; edge case: it might be unclear.", " I am not sure, this probably modifies a file.",
    " import a/b/c/d/e/f/g/h.go from module m -> it provides flow", " Cannot find it: not found, unknown.", " Interpretation: it parses input. Verification: ok. Accuracy: accurate",
    " mostly correct but wrong; purpose: creates", " ## Summary Location: line 3, a potential mismatch; the comment says so", " documentation is accurate and matches", "",
]
RESPONSES = f"""
SELECT conv_id, turn, coalesce(text, '') || {either("(conv_id * 3 + turn)", _SAID)} AS response FROM {{conversations}}"""
REPLIES = f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no reply' WHEN event_id % 7 = 1 THEN '{{"result": 1}}' ELSE '{{"structured_output": {{"score": ' || CAST(event_id % 13 AS STRING) || ', "reason": "' || event_type || '"}}}}' END AS reply FROM {{events}}"""
