import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwell.functions import markup, yaml_block

BLOCK = """# a comment
id: 12        # another
title: "A \\"b\\": c\\n\\u00e9"
'quoted key': 'it''s'
nested:
  deep:
    list:
    - one
    - two: 2
      more: [a, 'b, c', {x: 1, y: ~}]
    -
      - inner
      - 3.5
  empty: {}
text: |
  line one
    kept indent

  last

folded: >-
  some words
  go on

  new paragraph
   indented
keep: |+
  x

open: [1,
  2, # two
  3]
plain: goes on
  below
url: https://x.y/z#a
on: true
nothing:
"""


def test_block_of_every_kind():
    assert yaml_block.read(BLOCK) == {
        "id": 12,
        "title": 'A "b": c\né',
        "quoted key": "it's",
        "nested": {"deep": {"list": ["one", {"two": 2, "more": ["a", "b, c", {"x": 1, "y": None}]}, ["inner", 3.5]]}, "empty": {}},
        "text": "line one\n  kept indent\n\nlast\n",
        "folded": "some words go on\nnew paragraph\n indented",
        "keep": "x\n\n",
        "open": [1, 2, 3],
        "plain": "goes on below",
        "url": "https://x.y/z#a",
        "on": True,
        "nothing": None,
    }
    assert yaml_block.read("") == yaml_block.read("# only\n\n") == {}


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a\nb: 1", "- a", "a: [1, 2", "a: 1\n   b: 2\n c: 3", "\ta: 1", "a: &x 1", "a: 'open", "a: b: c", "a: {x: [}"])
def test_faults(text):
    with pytest.raises(yaml_block.YamlError):
        yaml_block.read(text)


keys = st.text(st.characters(exclude_categories=["Cs"]), min_size=1, max_size=8)
values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(exclude_categories=["Cs"]), max_size=12), lambda x: st.lists(x, max_size=3) | st.dictionaries(keys, x, max_size=3), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(keys, values, max_size=4))
def test_what_is_written_is_read_again(found):
    assert yaml_block.read(yaml_block.write(found)) == found


def test_documents_round_trip_as_columns(spark):
    texts = [
        "---\nid: 7\ntitle: T # x\nversion: 3\nlabels: [b, A]\nowner:\n  name: N\n  tags:\n  - x\n  - y\nnote: |\n  two\n  lines\n---\nBody\n---\nmore",
        "---\ntitle: 'only: this'\n---\n",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "content string").withColumn("fm", markup.parse_frontmatter(F.col("content")))
    first = [r["fm"] for r in df.collect()]
    assert first[0]["extra"] == {"owner": '{"name": "N", "tags": ["x", "y"]}', "note": '"two\\nlines\\n"'} and first[0]["error"] is None
    again = df.withColumn("written", markup.write_frontmatter(F.col("fm"))).withColumn("back", markup.parse_frontmatter(F.col("written"))).collect()
    for before, after in zip(first, again, strict=True):
        if before is None:
            assert after["written"] is None
        else:
            assert after["back"] == before.__class__(**before.asDict() | {"labels": sorted(x.lower() for x in before["labels"])})
