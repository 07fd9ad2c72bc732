from pyspark.sql import functions as F

from corpusloom.functions import jsons, times, urls
from corpusloom.functions import text as X


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_text(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, X.ascii_slug(s("Introdução à  Análise!"), "source")) == "introducao-a-analise"
    assert one(spark, X.plain_slug(s("Introdução"))) == "introdu-o" and one(spark, X.plain_slug(s("!!"))) == "untitled"
    assert one(spark, X.ascii_slug(s(None), "source")) == "source"
    assert one(spark, X.normalize_text(s("a \r\nb\n\n\n\nc\n"))) == "a\nb\n\nc"
    assert one(spark, X.normalize_lines(s(" a  b \n\n c "))) == "a b\nc"
    assert one(spark, X.split_labels(s(" a ;; b1 ; 2c"))) == ["a", "b1", "2c"]
    assert one(spark, X.title_tokens(s("The Árvore of um Dado, a b2"))) == ["árvore", "dado", "b2"]
    assert sorted(one(spark, X.meaning_tokens(s("The concept"), s("of trees; Árvore")))) == ["arvore", "trees"]
    assert one(spark, X.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert one(spark, X.jaccard(F.array().cast("array<string>"), F.array(F.lit("b")))) == 0
    assert one(spark, X.markdown_links(s("[a](b) ![c](d)"))) == 1 and one(spark, X.markdown_images(s("[a](b) ![c](d)"))) == 1
    assert one(spark, X.strip_fence(s("```json\n{}\n```"))) == "{}"
    assert one(spark, X.first_sentence(s("One here.  Two there."))) == "One here."
    assert one(spark, X.strip_trailing_punctuation(s("x).,"))) == "x" and one(spark, X.role_token(s(" Main Text-x "))) == "main_text_x"
    assert one(spark, X.display_prefix(s("adm-mo6 neg"))) == "ADMMO6" and one(spark, X.display_prefix(s("--"))) == "CG"
    assert one(spark, X.clean_cell(F.lit(3.0))) == "3" and one(spark, X.clean_cell(F.lit(3.5))) == "3.5" and one(spark, X.clean_cell(F.lit(None).cast("double"))) == ""
    assert one(spark, X.yaml_scalar(s('a "b"'))) == '"a \\"b\\""' and one(spark, X.yaml_scalar(s("plain 1"))) == "plain 1"


def test_urls(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, urls.normalize(s("HTTP://Ex.com//a//b/?z=1&a=2#f"))) == "http://ex.com/a/b?a=2&z=1"
    assert one(spark, urls.normalize(s("https://ex.com"))) == "https://ex.com/"
    assert one(spark, urls.clean(s("http://x/?a=1 e b=2?c=3"))) == "http://x/?a=1&b=2&c=3"
    assert one(spark, urls.youtube_id(s("https://www.youtube.com/watch?t=1&v=abcdef12345"))) == "abcdef12345"
    assert one(spark, urls.youtube_id(s("https://vimeo.com/1"))) is None
    assert one(spark, urls.github_raw_pdf(s("https://github.com/o/r/blob/main/a/b.PDF"))) == "https://raw.githubusercontent.com/o/r/main/a/b.PDF"
    assert one(spark, urls.github_raw_pdf(s("https://github.com"))) is None
    assert one(spark, urls.caption_as_vtt(s("http://c?fmt=srv3&x=1"))) == "http://c?fmt=vtt&x=1" and one(spark, urls.caption_as_vtt(s("http://c"))) == "http://c?fmt=vtt"
    assert one(spark, urls.image_mime_type(s("http://c/a.JPG?x"))) == "image/jpeg" and one(spark, urls.image_mime_type(s("http://c/a"))) == "image/png"
    assert one(spark, urls.host(s("https://u@Ex.com:80/x"))) == "ex.com" and one(spark, urls.is_pdf(s("http://x/a.PDF?q")))


def test_times(spark):
    s = lambda x: F.lit(x).cast("string")
    assert one(spark, times.date_iso(s("05/06/2024"))) == "2024-06-05" and one(spark, times.date_iso(s("99/99/2024"))) == "2024-99-99"
    assert one(spark, times.date_slug(s("5/6/2024"))) == "2024-06-05" and one(spark, times.date_slug(s("99/99/2024"))) == "99-99-2024"
    assert one(spark, times.timestamp_label(F.lit(62.5))) == "01:02" and one(spark, times.timestamp_label(F.lit(63.5))) == "01:04"
    assert one(spark, times.timestamp_label(F.lit(None).cast("double"))) == "unknown" and one(spark, times.timestamp_label(F.lit(3723))) == "1:02:03"
    assert one(spark, times.section_timestamp(F.lit(3723.25))) == "01:02:03.250"
    assert one(spark, times.seconds_of(s("1:02:03"))) == 3723 and one(spark, times.seconds_of(s("x"))) is None


def test_json(spark):
    assert one(spark, jsons.compact_json(b=F.lit(1), a=F.lit("ü"))) == '{"a":"ü","b":1}'
    assert one(spark, jsons.optional_int(F.lit("0"))) is None and one(spark, jsons.optional_int(F.lit("7.9"))) == 7 and one(spark, jsons.optional_float(F.lit("x"))) is None
