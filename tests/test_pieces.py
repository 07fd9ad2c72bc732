"""Stored pages, taxonomies and small forms against plain versions and odd inputs."""

import hashlib
import json
import re

import pytest

from corpusloom.operators import answers, pages, stages

VIDEO = (
    "id string, title string, url string, original_url string, final_url string, fetched_at string, cache_keys array<string>, model string, media_resolution string, fps double, prompt_version string, duration_seconds double, "
    "transcript_source string, transcript_sha256 string, body string, total_token_count bigint, warnings array<string>, gate_status string, gate_failures array<string>"
)


def plain(fields, body):
    quoted = lambda v: "null" if v is None else str(v) if isinstance(v, (int, float)) else json.dumps(v, ensure_ascii=False)
    lines = ["---"]
    for k, v in fields.items():
        lines += [f"{k}:" if v else f"{k}: []", *(f"  - {quoted(x)}" for x in v)] if isinstance(v, list) else [f"{k}: {quoted(v)}"]
    return "\n".join([*lines, "---"]) + f"\n\n{body}\n"


def test_videos_behind_their_front_matter(spark):
    rows = [
        ("1", 'A "b"', "u", "", "f", "t", ["k"], "m", "low", 1.0, "p", 10.5, "s", "h", "# é\n![i](x) [l](y) ![] [](z)\n \n", 7, ["w"], "ok", []),
        ("2", None, "u", "o", None, "t", ["k", "l"], "m", "high", 0.5, "p", None, "s", "h", "", None, [], "bad", ["x", "y"]),
        ("3", "", "u", None, None, None, [], None, None, None, None, 2.0, None, None, None, None, None, None, None),
    ]
    got = {r.id: r.markdown for r in pages.videos(spark.createDataFrame(rows, VIDEO)).collect()}
    for r in rows:
        v = dict(zip([c.split(" ")[0] for c in VIDEO.split(", ")], r))
        body = (v["body"] or "").rstrip()
        frame, known = (66 if v["media_resolution"] == "low" else 258), v["duration_seconds"] is not None and v["fps"] is not None
        fields = {
            "id": v["id"], "title": v["title"], "source_url": v["original_url"] or v["url"], "fetch_url": v["url"], "resolved_url": v["final_url"], "firecrawl_title": None, "description": None, "fetched_at": v["fetched_at"], "provider": "gemini_multimodal", "strategy": "video_gemini_two_pass",
            "cache_key": v["cache_keys"][0] if len(v["cache_keys"]) == 1 else None, "cache_keys": v["cache_keys"], "gemini_model": v["model"], "gemini_media_resolution": v["media_resolution"], "gemini_fps": v["fps"], "prompt_version": v["prompt_version"], "duration_seconds": v["duration_seconds"],
            "transcript_source": v["transcript_source"], "transcript_sha256": v["transcript_sha256"], "word_count": len(re.findall(r"\b\w+\b", body)), "char_count": len(body), "content_sha256": hashlib.sha256(body.encode()).hexdigest(),
            "image_count": len(re.findall(r"!\[[^\]]*]\([^)]+\)", body)), "link_count": len(re.findall(r"\[[^\]]+]\([^)]+\)", re.sub(r"!\[[^\]]*]\([^)]+\)", "", body))), "total_token_count": v["total_token_count"],
            "estimated_input_tokens": int(v["duration_seconds"] * (32 + v["fps"] * frame)) if known else None, "warnings": v["warnings"] or [], "gate_status": v["gate_status"], "gate_failures": v["gate_failures"] or [], "route_notes": [],
        }
        assert got[v["id"]] == plain(fields, body)


def test_articles_of_odd_rows(spark):
    schema = (
        "id string, title string, url string, fetch_url string, strategy string, notes array<string>, cache_key string, fetched_at string, content string, warnings array<string>, gate_status string, gate_failures array<string>, "
        "metadata struct<url:string,sourceURL:string,title:string,description:string,statusCode:int,contentType:string>, n_images int, n_links int, markdown string"
    )
    (row,) = pages.articles(spark.createDataFrame([(None,) * 16], schema)).collect()
    assert row.markdown.startswith("---\nid: null\n") and row.markdown.endswith("route_notes: []\n---\n\n\n") and "\nimage_count: 0\n" in row.markdown


def test_taxonomies_are_read_whole_or_not_at_all(spark):
    text = "x\nCONCEPTUAL (why it is): a\nPROCEDURAL (how to):\nFACTUAL ():\nAPPLIED (use (now): b\n"
    read = lambda t: spark.createDataFrame([(t,)], "t string").select(stages.taxonomy("t").alias("m")).first().m
    assert read(text) == {"conceptual": "why it is", "procedural": "how to", "factual": "", "applied": "use (now"}
    with pytest.raises(Exception, match="no definition of APPLIED"):
        read(text.replace("APPLIED", " APPLIED"))


def test_small_forms(spark):
    lesson = spark.createDataFrame([("l", "t", None, "2024", "L01", 5)], "lesson_id string, title string, description string, date string, display_code string, n int")
    assert stages.compact_lessons(lesson).collect() == [("l", "t", None, "2024", "L01")]
    odd = spark.createDataFrame([(i, a) for i, a in enumerate((None, "", "[]", "{}", '{"findings":"x","scores":3,"repair_instructions":[1,null,"s",{"b":1}]}'))], "scope_id int, answer string")
    got = answers.quality_audits(odd, "lesson segmentation").orderBy("scope_id").collect()
    assert [r.problem for r in got[:3]] == ["lesson segmentation quality audit output must be a JSON object"] * 3 and got[3].scores == "{}" and got[3].findings == [] and got[4].repair_instructions == ["1", "null", "s", '{"b":1}']
    kinds = answers.type_classifications(odd).orderBy("scope_id").collect()
    assert [r.classifications for r in kinds] == [None, None, None, [], []]
