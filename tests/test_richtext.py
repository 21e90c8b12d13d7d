import json

from pyspark.sql import functions as F

from tarnwell.functions import richtext

BODY = """# Title

Some **bold** and *soft* text with `code`, ~~gone~~ and a [link](a.md#x).

- one
- two
  - inner
- three

3. third
4. fourth

> quoted
>
> twice

```go
x := 1

y
```

---

Last\\
line"""


def test_round_trip():
    document = richtext.from_markdown(BODY)
    found = richtext.to_markdown(document)
    assert found == {"markdown": BODY, "warnings": []}
    assert richtext.from_markdown(found["markdown"]) == document
    kinds = [n["type"] for n in json.loads(document)["content"]]
    assert kinds == ["heading", "paragraph", "bulletList", "orderedList", "blockquote", "codeBlock", "rule", "paragraph"]


def test_unknown_nodes_keep_their_text():
    node = {"type": "doc", "content": [{"type": "panel", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "in"}]}]}, {"type": "table", "content": [{"content": [{"content": [{"type": "paragraph", "content": [{"type": "text", "text": "a|b"}]}]}]}]}]}
    assert richtext.to_markdown(json.dumps(node)) == {"markdown": "in\n\n| a\\|b |\n| --- |", "warnings": ["unsupported panel"]}
    assert richtext.to_markdown("x")["warnings"] == ["malformed document"]
    assert richtext.to_markdown("[]")["warnings"] == ["malformed document"]


def test_columns(spark):
    rows = spark.createDataFrame([("# A\n\nb",), (None,), ("",)], "x string").coalesce(1)
    got = rows.select(richtext.render_markdown(richtext.parse_markdown(F.col("x"))).alias("m")).collect()
    assert [r["m"] and r["m"]["markdown"] for r in got] == ["# A\n\nb", None, ""]
