"""File readers and writers."""

import json

from veloquent.sources.files import read_hotwords, read_tokens, read_transcripts, read_vocabulary, write_transcripts


def test_hotwords(spark, tmp_path):
    (tmp_path / "hot.txt").write_text("# note\n\nviet nam :2.5\na:b:3\nc:x\n plain \n")
    got = {r["phrase"]: r["score"] for r in read_hotwords(spark, str(tmp_path / "hot.txt")).collect()}
    assert got == {"VIET NAM": 2.5, "A:B": 3.0, "C:X": 1.5, "PLAIN": 1.5}


def test_tokens_and_vocabulary(spark, tmp_path):
    (tmp_path / "t.txt").write_text("<blk> 0\na 1\n")
    assert {tuple(r) for r in read_tokens(spark, str(tmp_path / "t.txt")).collect()} == {(0, "<blk>"), (1, "a")}
    (tmp_path / "v.txt").write_text("x\ny\n")
    assert {tuple(r) for r in read_vocabulary(spark, str(tmp_path / "v.txt")).collect()} == {("x", 2), ("y", 3)}


def test_transcripts_round_trip(spark, tmp_path):
    body = {"version": 1, "model": "m", "duration_sec": 2.5, "speaker_names": {"0": "Ân"}, "segments": [{"type": "speaker", "speaker": "Ân", "speaker_id": 0}, {"type": "text", "text": "đây", "start_time": 0.5, "raw_words": [{"text": "đây", "start": 0.5, "end": 0.7}]}]}
    (tmp_path / "a.json").write_text(json.dumps(body, ensure_ascii=False, indent=1))
    first = read_transcripts(spark, str(tmp_path / "a.json"))
    write_transcripts(first, str(tmp_path / "out"))
    again = read_transcripts(spark, str(tmp_path / "out"))
    assert first.collect() == again.collect()
    row = first.first()
    assert row["segments"][1]["raw_words"][0]["end"] == 0.7 and row["speaker_names"] == {"0": "Ân"} and row["overlap_segments"] is None
