"""A user's consumer on tables and on streams."""

import os

import pytest

from framelake.operators import user
from framelake.sources import raw_video

from .test_frames import frames, ramp


def recorder(folder):
    def take(rows):
        for r in rows:
            with open(os.path.join(folder, f"{r.stream_id}-{r.frame_no}"), "w") as f:
                f.write(str(sum(r.px)))

    return take


def test_consumers_get_every_frame(spark, tmp_path):
    source = ramp(6)
    df = frames(spark, source)
    expected = {f"s-{i}": str(float(a.sum())) for i, a in enumerate(source)}
    seen = lambda name: {p.name: p.read_text() for p in (tmp_path / name).iterdir()}
    for name in ("table", "stream"):
        (tmp_path / name).mkdir()
    assert user.consume(df, recorder(str(tmp_path / "table"))) is None
    assert seen("table") == expected
    df.where("frame_no < 4").write.parquet(str(tmp_path / "in"))
    stream = raw_video.stream_frames(spark, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="checkpoint"):
        user.consume(stream, print)
    for part in (df.where("frame_no >= 4"), None):
        user.consume(stream, recorder(str(tmp_path / "stream")), str(tmp_path / "held"), availableNow=True).awaitTermination()
        if part is not None:
            assert seen("stream") == {k: v for k, v in expected.items() if k < "s-4"}
            part.write.mode("append").parquet(str(tmp_path / "in"))
    assert seen("stream") == expected
