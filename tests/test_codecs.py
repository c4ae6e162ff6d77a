"""JPEG and PNG against values computed by hand and against the JVM's own codecs."""

import zlib

import numpy as np
import pytest

from lumenframe.sources import images, jpeg, png


def photo(h, w, channels=3, seed=0):
    """A smooth image with some edges, so that chroma is halved without surprises."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    planes = [128 + 90 * np.sin(x / (9 + k) + rng.random()) * np.cos(y / (7 + 2 * k)) for k in range(channels)]
    out = np.clip(np.stack(planes, 2), 0, 255).astype(np.uint8)
    out[h // 4 : h // 2, w // 3 : w // 2] = 200
    return out


def by_jvm(spark, data):
    """The image that the JVM's decoder gives, in BGR."""
    jvm = spark._jvm
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    h, w = picture.getHeight(), picture.getWidth()
    rgb = np.array(list(picture.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([rgb & 255, rgb >> 8 & 255, rgb >> 16 & 255], 2).astype(np.uint8)


def jvm_file(spark, array, kind, progressive=False):
    jvm = spark._jvm
    h, w, _ = array.shape
    picture = jvm.java.awt.image.BufferedImage(w, h, 1)
    wide = array.astype(int)
    for y in range(h):
        for x in range(w):
            picture.setRGB(x, y, int(wide[y, x, 2] << 16 | wide[y, x, 1] << 8 | wide[y, x, 0]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    params = writer.getDefaultWriteParam()
    if progressive:
        params.setProgressiveMode(1)
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), params)
    writer.getOutput().flush()
    return bytes(out.toByteArray())


def apart(a, b):
    return np.abs(a.astype(int) - b.astype(int))


def test_constants_by_hand():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]
    assert np.allclose(jpeg.COSINES @ jpeg.COSINES.T, np.eye(8))
    assert jpeg.quantiser(jpeg.LUMINANCE, 50)[:3].tolist() == [16, 11, 10] and jpeg.quantiser(jpeg.LUMINANCE, 100).max() == 1


@pytest.mark.parametrize("quality", [100, 95, 50])
def test_gray_blocks_by_hand(quality):
    """A block of one gray has one coefficient, eight times its distance from the middle, in steps of the table."""
    grays = np.arange(0, 256, 4, dtype=np.uint8)
    image = np.kron(grays.reshape(8, 8), np.ones((8, 8), np.uint8))[:, :, None]
    step = int(jpeg.quantiser(jpeg.LUMINANCE, quality)[0])
    want = np.clip(np.floor(np.rint(8.0 * (image - 128.0) / step) * step / 8 + 128.5), 0, 255)
    assert (jpeg.decode_jpeg(jpeg.encode_jpeg(image, quality)) == want).all()


def test_one_coefficient_by_hand():
    """A cosine of one frequency at full quality survives within the rounding of a sample."""
    wave = 100 * np.cos((2 * np.arange(8) + 1) * 3 * np.pi / 16)
    image = np.rint(np.tile(128 + wave, (8, 1))).astype(np.uint8)[:, :, None]
    assert apart(jpeg.decode_jpeg(jpeg.encode_jpeg(image, 100)), image).max() <= 1


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 33), (40, 25)])
@pytest.mark.parametrize("halve", [True, False])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_files_are_read_alike_by_the_jvm(spark, shape, halve, restart):
    image = photo(*shape)
    data = jpeg.encode_jpeg(image, 95, halve, restart)
    assert (data.count(b"\xff\xd0") > 0) == (restart > 0 and -(-shape[0] // (16 if halve else 8)) * -(-shape[1] // (16 if halve else 8)) > restart)
    mine = jpeg.decode_jpeg(data)
    assert apart(mine, by_jvm(spark, data)).max() <= (6 if halve else 3)
    assert apart(mine, image).mean() <= (8 if halve else 4)


def test_full_size_chroma_is_within_the_quantisers_bound():
    """Each coefficient is off by half a step at most, so a sample by half the steps' length; colours add up the planes'."""
    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (24, 40, 3), dtype=np.uint8)
    for quality in (100, 95, 80):
        luma, chroma = (np.sqrt((jpeg.quantiser(t, quality) ** 2.0).sum()) / 2 + 1 for t in (jpeg.LUMINANCE, jpeg.CHROMINANCE))
        off = apart(jpeg.decode_jpeg(jpeg.encode_jpeg(image, quality, halve=False)), image)
        # the mean square of a block's samples is that of its coefficients
        assert np.sqrt((off**2.0).mean()) <= luma / 8 + 1.772 * chroma / 8 + 1
    for sized in (photo(16, 16, 1), rng.integers(0, 256, (16, 16, 1), dtype=np.uint8)):
        off = apart(jpeg.decode_jpeg(jpeg.encode_jpeg(sized, 90)), sized).astype(float)
        blocks = off.reshape(2, 8, 2, 8).transpose(0, 2, 1, 3).reshape(4, 64)
        assert ((blocks**2).sum(1) <= (np.sqrt((jpeg.quantiser(jpeg.LUMINANCE, 90) ** 2.0).sum()) / 2 + 4) ** 2).all()


@pytest.mark.parametrize("shape", [(8, 8), (30, 50)])
def test_reads_what_the_jvm_writes(spark, shape):
    image = photo(*shape, seed=3)
    data = jvm_file(spark, image, "jpeg")
    assert apart(jpeg.decode_jpeg(data), by_jvm(spark, data)).max() <= 3
    assert (png.decode_png(jvm_file(spark, image, "png")) == image).all()


def test_refused_and_damaged_jpeg(spark):
    image = photo(40, 40)
    with pytest.raises(jpeg.JpegError):
        jpeg.decode_jpeg(jvm_file(spark, image, "jpeg", progressive=True))
    data = jpeg.encode_jpeg(image)
    for bad in (b"", b"\xff\xd8", data[:100], data[: len(data) // 2], data.replace(b"\xff\xc0", b"\xff\xc9"), data[:20] + data[60:]):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode_jpeg(bad)
    with pytest.raises(jpeg.JpegError):
        jpeg.encode_jpeg(np.zeros((0, 4, 3), np.uint8))


def test_long_codes_are_shortened():
    counts = np.zeros(256, np.int64)
    counts[:30] = [int(1.7**k) + 1 for k in range(30)]
    lengths = jpeg._code_lengths(counts)
    assert set(lengths) == set(range(30)) and max(lengths.values()) <= 16
    assert sum(2.0**-n for n in lengths.values()) < 1  # room for the code of all ones
    assert jpeg._code_lengths(np.eye(256, dtype=np.int64)[7]) == {7: 1}


def test_orientation():
    image = photo(16, 24)
    plain = jpeg.encode_jpeg(image, 95, False)
    seen = jpeg.decode_jpeg(plain)
    for kind, want in ((1, seen), (2, seen[:, ::-1]), (3, seen[::-1, ::-1]), (4, seen[::-1]), (6, np.rot90(seen, -1)), (8, np.rot90(seen)), (5, seen.transpose(1, 0, 2))):
        for order, name in (("little", b"II*\0"), ("big", b"MM\0*")):
            field = b"".join(v.to_bytes(n, order) for v, n in ((8, 4), (1, 2), (0x0112, 2), (3, 2), (1, 4), (kind, 2), (0, 2)))
            exif = b"Exif\0\0" + name + field
            turned = plain[:2] + b"\xff\xe1" + (len(exif) + 2).to_bytes(2) + exif + plain[2:]
            assert (jpeg.decode_jpeg(turned) == want).all(), kind


def png_file(samples, depth, colour, interlaced=False, palette=None, filters=(0, 1, 2, 3, 4)):
    """An encoder of its own: rows or Adam7 passes, filters in turn."""
    h, w, channels = samples.shape

    def packed(part):
        if depth == 16:
            return np.ascontiguousarray(part, ">u2").view(np.uint8).reshape(len(part), -1)
        flat = part.reshape(len(part), -1).astype(np.uint8)
        if depth == 8:
            return flat
        return np.packbits((flat[:, :, None] >> np.arange(depth)[::-1] & 1).reshape(len(part), -1).astype(np.uint8), axis=1)

    body = b""
    for x, y, dx, dy in png.PASSES if interlaced else ((0, 0, 1, 1),):
        part = samples[y::dy, x::dx]
        if not part.size:
            continue
        tried = png.filtered(packed(part), max(1, channels * depth // 8)).astype(np.uint8)
        for k in range(len(part)):
            body += bytes([filters[k % len(filters)]]) + tried[filters[k % len(filters)], k].tobytes()
    header = w.to_bytes(4) + h.to_bytes(4) + bytes([depth, colour, 0, 0, int(interlaced)])
    stored = zlib.compress(body)
    out = png.SIGNATURE + png._chunk(b"IHDR", header) + (png._chunk(b"PLTE", palette) if palette else b"")
    return out + png._chunk(b"tEXt", b"x\0y") + png._chunk(b"IDAT", stored[:7]) + png._chunk(b"IDAT", stored[7:]) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("size", [(1, 1), (5, 3), (9, 20)])
@pytest.mark.parametrize(("colour", "depth"), [(0, 1), (0, 2), (0, 4), (0, 8), (0, 16), (2, 8), (2, 16), (3, 1), (3, 4), (3, 8), (4, 8), (6, 8), (6, 16)])
def test_png_kinds(spark, colour, depth, size, interlaced):
    rng = np.random.default_rng(depth * 10 + colour)
    samples = rng.integers(0, 1 << depth, (*size, png.CHANNELS[colour]))
    palette = rng.integers(0, 256, (1 << min(depth, 8), 3), dtype=np.uint8)
    data = png_file(samples, depth, colour, interlaced, palette.tobytes() if colour == 3 else None)
    eight = samples >> 8 if depth == 16 else samples * (255 // ((1 << depth) - 1)) if colour != 3 else samples
    want = palette[eight[:, :, 0]] if colour == 3 else eight[:, :, : 3 if colour in (2, 6) else 1]
    got = png.decode_png(data)
    assert got.shape == want.shape and (got == want[:, :, ::-1]).all()
    if colour in (2, 3) and depth <= 8:
        assert (by_jvm(spark, data) == got).all()


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (1, 2), (3,), (4,)])
def test_png_filters_by_hand(filters):
    rows = np.array([[1, 2, 3, 4], [5, 6, 7, 250], [9, 200, 7, 0]])
    assert (png.decode_png(png_file(rows[:, :, None], 8, 0, filters=filters))[:, :, 0] == rows).all()
    by_hand = {0: rows[1], 1: [5, 1, 1, 243], 2: [4, 4, 4, 246], 3: [5, 3, 3, 245], 4: [4, 1, 1, 243]}
    assert png.filtered(rows, 1)[filters[0], 1].tolist() == list(by_hand[filters[0]])


def test_png_round_trip_and_damage(spark):
    rng = np.random.default_rng(1)
    for image in (photo(20, 31), photo(20, 31, 1), rng.integers(0, 256, (1, 1, 3), dtype=np.uint8), rng.integers(0, 256, (30, 9, 3), dtype=np.uint8)):
        data = png.encode_png(image)
        assert (png.decode_png(data) == image).all()
        assert (by_jvm(spark, data) == image).all() or image.shape[2] == 1
    data = png.encode_png(photo(20, 31))
    short = png.SIGNATURE + png._chunk(b"IHDR", data[16:29]) + png._chunk(b"IDAT", zlib.compress(b"\0" * 9)) + png._chunk(b"IEND", b"")
    wrong = data[:40] + bytes([data[40] ^ 1]) + data[41:]
    for bad in (b"", data[:50], wrong, data[:-12], short, png_file(np.full((2, 2, 1), 3), 2, 3, palette=b"\0\0\0")):
        with pytest.raises(png.PngError):
            png.decode_png(bad)


def test_image_files_of_all_kinds(spark, tmp_path):
    image = photo(12, 10)
    files = {"a.jpg": jpeg.encode_jpeg(image), "b.png": png.encode_png(image), "c.ppm": images.encode_pnm(image), "d.jpg": jpeg.encode_jpeg(image)[:200], "e.txt": b"no image", "f.png": b"\x89", "g.jpg": jvm_file(spark, image, "jpeg", progressive=True)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = images.read_images(spark, f"file://{tmp_path}")
    assert images.readable(read).count() == 3
    assert tuple(images.unreadable_count(read).first()) == (7, 4)
    sizes = {(r.image.height, r.image.width, r.image.n_channels) for r in images.readable(read).collect()}
    assert sizes == {(12, 10, 3)}
