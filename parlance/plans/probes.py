"""Texts with planted secrets: the test tables hold few, so each query adds some by the same SQL in Spark and in DuckDB."""

from __future__ import annotations

#: Appended to a document's text by its id; both engines read it as it is.
PROBE = """text || CASE doc_id % 9
WHEN 0 THEN ' key sk-' || repeat('aB3x', 6) || ' and sk-short'
WHEN 1 THEN ' ghp_' || repeat('Z9', 12) || ' tail'
WHEN 2 THEN ' id AKIA' || repeat('Q7', 8) || ' é1234567 end'
WHEN 3 THEN ' bearer abcdefgh.ij-k Bearer short'
WHEN 4 THEN ' see /home/auth/x and C:\\credentials\\y or .env'
WHEN 5 THEN ' password=hunter2 hotel = 12 name=joe token=[TOKEN] api_key = k1;x'
WHEN 6 THEN ' https://h.example/p?token=abc&email=a.b@c.org&q=1&code=9'
WHEN 7 THEN ' Authorization: Bearer abc.def Authorization: Basic Zm9v X-Api-Key: k'
ELSE ' { "session_id": "s1", "password": "p w", "user": "joe", "api-key": "zz" }' END"""

SPARK_PROBE = PROBE.replace("\\", "\\\\")

#: Lines of assignments and cookie headers after a document's text.
LINES = """text || chr(10) || CASE doc_id % 6
WHEN 0 THEN 'export API_KEY=abc123'
WHEN 1 THEN 'password: p1 # old' || chr(10) || 'name: joe'
WHEN 2 THEN 'Cookie: sid=1; Theme=dark; HttpOnly; empty=; x=a=b'
WHEN 3 THEN 'set-cookie: Token = t; Path=/' || chr(10) || 'Authorization: none'
WHEN 4 THEN '  my.secret = s;t u'
ELSE 'hotel:5' || chr(10) || 'session: { x }' END"""

SPARK_LINES = LINES
