import re

import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm.pieces import CharMap, PieceModel, load, pieces, wire_fields

PATH = public.path("piece_bpe_32k.model")
TEXTS = [
    "",
    " ",
    "Hello  world\n ok <s> é",
    "▁raw mark ▁▁x",
    "tabs\tand\r\nends  ",
    "中文字 emoji 😀 é ﬁ Ⅳ",
    "x" * 5000 + " " + "ab" * 3000,
    "<0x41><unk></s>",
    "no\x00null",
]


def same(text):
    model = load(PATH)
    ids, starts, stops = model.encode(text)
    proto = model.library.encode(text, return_type="proto")
    assert ids.tolist() == [p.id for p in proto.pieces]
    assert starts.tolist() == [p.begin for p in proto.pieces]
    assert stops.tolist() == [p.end for p in proto.pieces]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_spans_equal_the_library(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n▁aetho .!")), max_size=60))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_compiled_character_map(rule):
    try:
        library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    except Exception:  # noqa: BLE001
        pytest.skip("the library has no such rule")
    fields = dict(wire_fields(b"".join(v for k, v in wire_fields(library.serialized_model_proto()) if k == 3)))
    model = object.__new__(PieceModel)
    model.char_map = CharMap(fields[2])
    assert model.char_map.units
    model.escape, model.suffix = True, False
    for prefix, strip in ((False, False), (True, True), (False, True)):
        model.dummy_prefix, model.strip = prefix, strip
        for text in ["", "  ", "ＡＢＣ  ﬁn é Ⅳ ㌔ 가　x ", " \tzwj‍ …", "Grüße ǅ ẛ̣"]:
            got, align = model.normalise(text)
            want = library.normalize(text)
            plain, want = got.replace("▁", " ").strip(), want.replace("▁", " ").strip()
            assert (plain if strip else re.sub(" +", " ", plain)) == want
            assert len(align) == len(got.encode()) + 1 and (align[1:] >= align[:-1]).all()


def test_column_with_nulls_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (2, "a  b", 5), (2, "a  b", 5)], "doc_id int, text string, ids int")
    rows = df.select("ids", pieces(df.text, PATH).alias("p")).collect()
    assert rows[0].p.ids == rows[1].p.ids == [1, 2] and rows[0].p.decoded == ""
    assert rows[2].p == rows[3].p and rows[2].p.decoded == "a  b" and rows[2].ids == 5
    assert rows[2].p.starts[0] == 0 and rows[2].p.stops[-1] == 4
    assert df.limit(0).select(pieces(df.text, PATH)).collect() == []
