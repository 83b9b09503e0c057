import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import config
from tidemark.sources import avi, decode


def clip_bytes(images, fps=25.0, index=True):
    height, width = images[0].shape[:2]
    channels = 1 if images[0].ndim == 2 else 3
    size = avi.frame_bytes(width, height, channels)
    body = avi.avi_head(width, height, channels, len(images), fps) + b"".join(map(avi.frame_chunk, images))
    return body + (avi.avi_index(len(images), size) if index else b"")


def moving(n, width=37, height=26, gray=False):
    rng = np.random.default_rng(n)
    clip = rng.integers(0, 40, (n, height, width, 3), dtype=np.uint8)
    for k in range(n):
        clip[k, 5:15, k % 20 : k % 20 + 9] = 210
    return list(clip[..., 0] if gray else clip)


def signals(df):
    return sorted((r.clip_id.rpartition("/")[2], r.frame_idx, r.brightness, r.motion, r.aspect_ratio, r.area, r.total_frames, r.fps) for r in df.collect())


def single(name, images, fps=25.0, most=600):
    rows = decode.frame_rows(iter(images), config.Settings(max_frames=most))
    return [(name, k, *values[:4], len(images), fps) for k, *values in rows]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.avi").write_bytes(clip_bytes(moving(30)))
    (tmp_path / "deep" / "b.avi").write_bytes(clip_bytes(moving(17, 24, 31, True), 12.5))
    (tmp_path / "c.avi").write_bytes(clip_bytes(moving(9), index=False))
    (tmp_path / "bad.avi").write_bytes(b"RIFF no clip")
    (tmp_path / "empty.avi").write_bytes(b"")
    (tmp_path / "none.avi").write_bytes(clip_bytes([np.zeros((4, 4), np.uint8)])[:200])
    (tmp_path / "other.txt").write_bytes(clip_bytes(moving(3)))
    return tmp_path


def test_frames_are_those_of_one_task_for_any_partitions(spark, folder):
    want = sorted(single("a.avi", moving(30)) + single("b.avi", moving(17, 24, 31, True), 12.5) + single("c.avi", moving(9)))
    largest = (folder / "a.avi").stat().st_size
    seen = set()
    for parts in (1, 2, 7, 40):
        df = avi.read_avi(spark, str(folder), partitionBytes=-(-largest // parts))
        seen.add(df.rdd.getNumPartitions())
        assert signals(df) == want
    assert len(seen) == 4 and max(seen) > 40
    assert signals(avi.read_avi(spark, f"file://{folder}", partitionBytes=5000)) == want


def test_whole_files_decode_to_the_same_frames(spark, folder):
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.avi").load(str(folder))
    assert signals(decode.decode(files, avi.AviDecoder())) == signals(avi.read_avi(spark, str(folder)))


def test_frames_cap_and_one_file(spark, folder):
    got = signals(avi.read_avi(spark, str(folder / "a.avi"), maxFrames=11, partitionBytes=9000))
    assert got == single("a.avi", moving(30), most=11)
    assert avi.read_avi(spark, str(folder), pathGlobFilter="*.none").collect() == []


def test_a_file_that_breaks_off_has_the_frames_that_are_there(spark, tmp_path):
    whole = clip_bytes(moving(12))
    (tmp_path / "cut.avi").write_bytes(whole[: len(whole) // 2])
    got = signals(avi.read_avi(spark, str(tmp_path)))
    assert 4 <= len(got) <= 6 and [r[1:6] for r in got] == [r[1:6] for r in single("cut.avi", moving(12))[: len(got)]]


def test_two_segments_and_top_down_rows(tmp_path):
    import io

    first, second = moving(5), moving(4)
    body = clip_bytes(first)
    more = b"".join(map(avi.frame_chunk, second))
    body += b"RIFF" + (4 + 8 + 4 + len(more)).to_bytes(4, "little") + b"AVIXLIST" + (4 + len(more)).to_bytes(4, "little") + b"movi" + more
    f = io.BytesIO(body)
    header, starts, sizes = avi.read_index(f, len(body))
    images = []
    for a, n in zip(starts, sizes):
        f.seek(int(a))
        images.append(avi.frame_image(header, f.read(int(n))))
    assert all((x == y).all() for x, y in zip(images, first + second, strict=True))
    top = avi.Header(header.fps, header.width, header.height, 24, header.codec, header.stream, True)
    f.seek(int(starts[0]))
    assert (avi.frame_image(top, f.read(int(sizes[0])))[::-1] == first[0]).all()
    with pytest.raises(ValueError):
        avi.frame_image(avi.Header(25.0, 4, 4, 24, b"H264", b"00", False), b"x" * 48)


def test_short_clips_share_partitions(spark, tmp_path):
    body = clip_bytes(moving(3, 8, 8, True))
    for k in range(600):
        (tmp_path / f"{k:03}.avi").write_bytes(body)
    df = avi.read_avi(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() <= 3
    assert df.groupBy("clip_id").count().where("count = 3").count() == 600


@pytest.mark.parametrize("gray", [True, False])
def test_stacks_of_frames_measure_as_single_ones(monkeypatch, gray):
    images = moving(40, 23, 17, gray)
    many = [r[:-1] for r in decode.frame_rows(iter(images))]
    monkeypatch.setattr(decode, "BATCH_FRAMES", 1)
    assert [r[:-1] for r in decode.frame_rows(iter(images))] == many


def test_short_clips_share_stacks():
    clips = [(f"{k}.avi", moving(1 + k % 5, 9 if k % 50 == 49 else 8, 8, True)) for k in range(300)]
    clips.insert(7, ("long.avi", moving(4_500, 8, 8, True)))
    got, stacks = {}, 0
    for runs, columns in decode.clip_stacks(((name,), iter(images)) for name, images in clips):
        rows = iter(zip(*(c.tolist() for c in columns[:-1]), strict=True))
        stacks += 1
        for (name,), first, n in runs:
            got.setdefault(name, []).extend((first + k, *next(rows)) for k in range(n))
        assert not list(rows)
    most = config.DEFAULTS.max_frames
    assert got == {name: [r[:-1] for r in decode.frame_rows(iter(images))] for name, images in clips} and len(got["long.avi"]) == most
    assert stacks < 20


def test_an_upload_that_breaks_inside_costs_no_other(spark, tmp_path):
    body = clip_bytes(moving(6))
    codec = body.index(b"strf") + 8 + 16
    (tmp_path / "good.avi").write_bytes(body)
    (tmp_path / "coded.avi").write_bytes(body[:codec] + b"H264" + body[codec + 4 :])
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert signals(decode.decode(files, avi.AviDecoder())) == sorted(single("good.avi", moving(6))) == signals(avi.read_avi(spark, str(tmp_path)))


class Grows:
    """Three frames, then a larger one, as the bytes of each file."""

    def open(self, content):
        return 0.0, 4, iter([*moving(3), moving(1, 60, 60)[0]])


def test_a_clip_ends_where_its_frames_change_size(spark, tmp_path):
    for name in ("a.mp4", "b.mp4"):
        (tmp_path / name).write_bytes(b"x")
    got = signals(decode.decode(spark.read.format("binaryFile").load(str(tmp_path)), Grows()))
    assert [r[:6] for r in got] == [r[:6] for name in ("a.mp4", "b.mp4") for r in single(name, moving(3))] and {r[6] for r in got} == {4}


@pytest.mark.parametrize("channels", [1, 3])
def test_clips_written_in_pieces(spark, tmp_path, monkeypatch, channels):
    from tidemark.sources import sinks

    images = {f"c{n}": moving(n, 7, 5, channels == 1) for n in (1, 2, 9)}
    rows = spark.createDataFrame([(c, k, image.tobytes()) for c, v in images.items() for k, image in enumerate(v)], "clip_id string, frame_idx int, pixels binary")
    for piece in (1, 1 << 20):
        monkeypatch.setattr(sinks, "CHUNK_BYTES", piece)
        assert sinks.write_clips(rows, str(tmp_path / str(piece)), 7, 5, channels) == 3
        for c, v in images.items():
            assert (tmp_path / str(piece) / f"{c}.avi").read_bytes() == clip_bytes(v)
    short = rows.withColumn("pixels", F.expr("substring(pixels, 1, if(clip_id = 'c9' and frame_idx = 8, 4, 1000))"))
    with pytest.raises(Exception, match="clip c9"):
        sinks.write_clips(short, str(tmp_path / "short"), 7, 5, channels)


@pytest.mark.parametrize("pixels", [1, 2, 4, 30, 255])
def test_thresholds_over_few_pixels_are_those_over_levels(pixels):
    rng = np.random.default_rng(pixels)
    for top in (1, 2, 5, 256):
        few = rng.integers(0, top, (500, 1, pixels), dtype=np.uint8)
        # 256 copies of an image have its levels in its shares
        assert (decode._thresholds(few) == decode._thresholds(np.repeat(few, 256, axis=1))).all()


def test_frames_before_one_that_cannot_be_read_stay():
    def broken():
        yield from moving(5)
        raise ValueError

    rows = decode.frame_rows(broken())
    assert [next(rows)[0] for _ in range(5)] == list(range(5))
