"""Kernels on small images: literals, guards and invariants."""

import collections
import io
import os
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest

from rasterloom.operators import kernels as K
from rasterloom.operators import network as N
from rasterloom.operators import synthesis as S
from rasterloom.sources.images import encode_png, read_config


def page(h=64, w=64, level=255):
    return np.full((h, w), level, dtype=np.uint8)


def test_white_point_of_constant_paper():
    assert K.white_point(page(100, 100, 233)) == 223


def test_stretch_white_literals():
    img = page(10, 10, 233)
    img[0, :3] = (0, 224, 220)
    out = K.stretch_white(img, 223)
    assert out[0, 0] == 0 and out[0, 1] == 255 and out[0, 2] >= 250 and out[5, 5] == 255


@pytest.mark.parametrize("call", [lambda: K.stretch_white(page(), 0), lambda: K.stretch_black(page(), 255), lambda: K.thicken(page(), -1), lambda: K.remove_small_dots(page(), 0), lambda: K.adaptive_ink(page(), 24), lambda: K.combined_loss(page() / 255, page() / 255, 1.5), lambda: S.recipes(None, 0, 64), lambda: encode_png(page().astype(float))])
def test_guards(call):
    with pytest.raises(ValueError):
        call()


def test_black_point_without_ink_changes_nothing():
    assert K.black_point(page()) == 0 and (K.boost_black(page(8, 8, 200)) == 200).all()


def test_dot_goes_and_stroke_stays():
    img = page(20, 20)
    img[10, 10] = img[15:18, 15] = 0
    out = K.remove_small_dots(img, 3)
    assert out[10, 10] == 255 and (out[15:18, 15] == 0).all()


def test_dots_go_before_strokes_grow():
    img = page(40, 40, 233)
    img[5, 5] = img[20:25, 20] = 0
    out = K.postprocess(img)
    assert out[5, 5] == 255 and out[22, 19] == 0


@pytest.mark.parametrize(("n", "want"), [(256, 256), (100, 256), (300, 384), (512, 512)])
def test_padded_size(n, want):
    assert K.padded_size(n, 256, 128) == want


@pytest.mark.parametrize("shape", [(137, 211), (50, 60), (1, 5)])
def test_padding_mirrors(shape):
    img = np.random.default_rng(0).integers(0, 255, shape).astype(np.uint8)
    out = K.pad_to_tiles(img, 64, 32)
    assert (out[: shape[0], : shape[1]] == img).all() and out.shape[0] >= 64
    if shape[0] > 2:
        assert (out[shape[0], : shape[1]] == img[shape[0] - 2]).all()


def brute_extreme(img, offsets, pick, outside):
    out = img.copy()
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            held = [img[y + dy, x + dx] for dy, dx in offsets if 0 <= y + dy < img.shape[0] and 0 <= x + dx < img.shape[1]]
            out[y, x] = pick(held) if held else outside
    return out


@pytest.mark.parametrize("offsets", [K.ellipse(1), K.ellipse(3), K.rectangle(1, 2, 0, 3)])
def test_extremes_match_brute_force(offsets):
    img = np.random.default_rng(1).integers(0, 256, (13, 17)).astype(np.uint8)
    assert (K.erode(img, offsets) == brute_extreme(img, offsets, min, 255)).all()
    assert (K.dilate(img, offsets) == brute_extreme(img, offsets, max, 0)).all()


def test_labels_match_flood_fill():
    mask = np.random.default_rng(2).random((40, 50)) < 0.35
    labels, n = K.label(mask)
    seen = np.zeros_like(labels)
    count = 0
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        count += 1
        todo = [(y, x)]
        seen[y, x] = count
        while todo:
            a, b = todo.pop()
            for c in range(max(0, a - 1), min(40, a + 2)):
                for d in range(max(0, b - 1), min(50, b + 2)):
                    if mask[c, d] and not seen[c, d]:
                        seen[c, d] = count
                        todo.append((c, d))
    assert n == count and len(set(zip(labels[mask], seen[mask]))) == count and not labels[~mask].any()


def test_line_residue_keeps_long_lines_only():
    ink = np.zeros((60, 200), dtype=bool)
    ink[30, 20:180] = True
    ink[10, 20:60] = True
    out = K.line_residue(ink, 120)
    assert out[30].any() and not out[10].any()


def test_inpaint_changes_masked_pixels_only():
    img = np.random.default_rng(3).integers(100, 110, (20, 20, 3)).astype(np.uint8)
    mask = np.zeros((20, 20), dtype=bool)
    assert (K.inpaint(img, mask) == img).all()
    mask[8:11, 4:16] = True
    img[mask] = 0
    out = K.inpaint(img, mask)
    assert (out[~mask] == img[~mask]).all() and (out[mask] >= 99).all() and (out == K.inpaint(img, mask)).all()


def test_digitize_is_binary_and_drops_the_grid():
    img = np.full((300, 300, 3), 235, dtype=np.uint8)
    img[20::30] = img[:, 20::30] = (200, 150, 110)
    img[140:160, 147:151] = 20
    out, stages, _ = K.digitize(img)
    assert set(np.unique(out)) <= {0, 255} and (out[142:158, 148:150] == 0).all()
    assert (out == 0).mean() < 0.01 and not stages["color"].any()


def test_red_ink_is_found():
    img = np.full((30, 30, 3), 230, dtype=np.uint8)
    img[10:13, 5:25] = (40, 40, 200)
    assert K.color_ink(img)[11, 6:24].all() and not K.color_ink(img)[25].any()


def test_metrics_of_equal_images():
    img = np.random.default_rng(4).integers(0, 256, (32, 32)).astype(np.uint8)
    assert K.psnr(img, img) == float("inf") and K.ssim(img, img) == pytest.approx(1) and K.combined_loss(img / 255, img / 255) == pytest.approx(0)
    half = page(10, 10)
    half[:5] = 0
    assert K.ink_percent(half) == 50 and len(K.mscn_features(img)) == 15


def test_clean_background():
    grid = np.full((256, 256, 3), 235, dtype=np.uint8)
    grid[14::14] = grid[:, 14::14] = (120, 100, 100)
    drawn = grid.copy()
    for i in range(100):
        drawn[60 + i, 60 + i : 64 + i] = 0
    assert K.clean_background(grid) and not K.clean_background(drawn) and not K.clean_background(np.full((256, 256, 3), 235, np.uint8))


def test_harvest_keeps_distance():
    big = np.full((800, 800, 3), 235, dtype=np.uint8)
    big[14::14] = big[:, 14::14] = (120, 100, 100)
    kept = K.harvest(big)
    assert kept and all(max(abs(a - c), abs(b - d)) >= 128 for i, (a, b) in enumerate(kept) for c, d in kept[:i])


@pytest.mark.parametrize("how", ["area", "linear", "cubic", "nearest"])
def test_resize_of_constant(how):
    assert (K.resize(page(30, 40, 77), 13, 17, how) == 77).all() and K.resize(page(10, 10), 25, 20, how).shape == (25, 20)


def test_network_size_shape_and_batches():
    weights = N.initial()
    assert N.parameters(weights) == 482_449
    small = N.initial(3, (2, 4))
    x = np.random.default_rng(5).random((3, 1, 16, 16))
    out = N.forward(small, x)
    assert out.shape == x.shape and (out > 0).all() and (out < 1).all()
    assert np.allclose(out[1:2], N.forward(small, x[1:2]), atol=1e-6)
    assert all((a == b).all() for a, b in zip(N.load(N.save(small)).values(), small.values()))
    with pytest.raises(ValueError):
        N.forward(small, np.zeros((1, 1, 15, 16)))


def test_gradients():
    weights = N.initial(1, (2, 4))
    rng = np.random.default_rng(6)
    x, y = rng.random((2, 1, 8, 8)), rng.random((2, 1, 8, 8))
    grads = N.loss_step(weights, x, y)[1]
    for key in ("rise0.weight", "head.weight", "up0.norm1.shift"):
        at = (0,) * weights[key].ndim
        moved = [{k: w.copy() for k, w in weights.items()} for _ in range(2)]
        moved[0][key][at] += 1e-2
        moved[1][key][at] -= 1e-2
        slope = (N.loss_step(moved[0], x, y)[0] - N.loss_step(moved[1], x, y)[0]) / 2e-2
        assert grads[key][at] == pytest.approx(slope, rel=0.1, abs=1e-5)


def test_training_lowers_loss_and_needs_pairs():
    planes = np.random.default_rng(7).random((10, 1, 16, 16)).astype(np.float32)
    _, log = N.train((planes, planes), epochs=4, widths=(4, 8), rate=1e-2)
    assert log[-1]["train_loss"] < log[0]["train_loss"] and log[-1]["lr"] == pytest.approx(1e-4)
    with pytest.raises(ValueError):
        N.train((planes[:1], planes[:1]))


def test_pages_come_again_from_their_index():
    for i in range(12):
        a, b = S.render(S.recipe(i, 64)), S.render(S.recipe(i, 64))
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all() and a[0].shape == (64, 64, 3)


def test_degradations_never_brighten():
    sheet = S.paper(64, 64, 230, 10, 5, 3, 1)
    before = sheet.copy()
    drawn = S.draw(sheet, [{"points": [(5, 5), (50, 40)], "thickness": 2}])
    assert (drawn <= sheet).all() and (sheet == before).all()
    for mode in S.ILLUMINATIONS:
        assert (S.light(drawn, mode, 0.5, [0.1, 0.2, 0.3, 0.4], 1) <= drawn).all()
    assert (S.stain(drawn, 0.5, [120, 125, 140], [[30, 30, 10, 8, 0.3]]) <= drawn).all() and (S.bleed(drawn, 0.2, 1.5, [{"points": [(5, 5), (50, 40)], "thickness": 2}]) <= drawn).all()
    layer = S.line_layer(64, 64, "grid", 14, 1, 0.0, [90, 80, 80])
    assert (S.blend_lines(drawn, layer, 0.9, True) <= drawn).all()
    with pytest.raises(ValueError):
        S.light(drawn, "none", 0.5, [0, 0, 0, 0], 1)


def test_real_background_is_not_enlarged():
    tile = np.full((100, 100, 3), 200, dtype=np.uint8)
    dirty, clean = S.render(S.recipe(0, 128, tiles=1, tile_prob=1.0), [tile])
    assert dirty.shape == clean.shape == (100, 100, 3)


def test_apportion_and_config():
    assert sum(S.apportion(23, S.STROKES)) == 23 and S.apportion(20, S.STROKES)[0] == 8
    assert read_config(None) == {} and read_config("[1]") == {} and read_config("{bad") == {} and read_config('{"a": 1}') == {"a": 1}


def test_slope_of_the_combined_loss():
    rng = np.random.default_rng(6)
    a, b = rng.random((14, 17)), rng.random((14, 17))
    same, slope = K.ssim_slope(a, b)
    assert abs(same - K.ssim(a, b, "gaussian", 1.0)) < 1e-12
    for y, x in ((0, 0), (7, 8), (13, 16), (4, 2)):
        moved = [a.copy(), a.copy()]
        moved[0][y, x] += 1e-5
        moved[1][y, x] -= 1e-5
        assert abs((K.ssim_slope(moved[0], b)[0] - K.ssim_slope(moved[1], b)[0]) / 2e-5 - slope[y, x]) < 1e-7
    with pytest.raises(ValueError):
        K.ssim_slope(a[:10], b[:10])


def _checkpoint(held, path):
    """What a framework writes: a zip with a pickle that names storages, and the storages."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    torch.FloatStorage = type("FloatStorage", (), {"__module__": "torch"})
    exec("def _rebuild_tensor_v2(*a): pass", utils.__dict__)
    sys.modules |= {"torch": torch, "torch._utils": utils}

    class Tensor:
        def __init__(self, key, array):
            self.key, self.array = key, array

    class Storage:
        def __init__(self, key, array):
            self.pid = ("storage", torch.FloatStorage, key, "cpu", array.size)

    class Writer(pickle.Pickler):
        def persistent_id(self, x):
            return x.pid if isinstance(x, Storage) else None

    Tensor.__reduce__ = lambda self: (utils._rebuild_tensor_v2, (Storage(self.key, self.array), 0, self.array.shape, tuple(s // 4 for s in self.array.strides), False, collections.OrderedDict()))
    body = io.BytesIO()
    Writer(body, 2).dump(collections.OrderedDict((k, Tensor(str(i), v)) for i, (k, v) in enumerate(held.items())))
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("best/data.pkl", body.getvalue())
        for i, v in enumerate(held.values()):
            out.writestr(f"best/data/{i}", v.astype("<f4").tobytes())
    for name in ("torch", "torch._utils"):
        del sys.modules[name]


def test_checkpoints_of_named_tensors(tmp_path):
    """A network of two steps under the names of a checkpoint gives what a plain forward pass gives."""
    rng, held = np.random.default_rng(7), {}
    for name, a, b in (("enc1", 1, 2), ("bottleneck", 2, 4), ("dec1", 4, 2)):
        for at, (i, o) in ((0, (a, b)), (3, (b, b))):
            held[f"{name}.block.{at}.weight"] = rng.normal(0, 0.5, (o, i, 3, 3)).astype("f4")
            for part in ("weight", "bias", "running_mean", "running_var"):
                held[f"{name}.block.{at + 1}.{part}"] = rng.uniform(0.5, 1.5, o).astype("f4")
    held |= {"up1.weight": rng.normal(0, 0.5, (4, 2, 2, 2)).astype("f4"), "up1.bias": rng.normal(0, 1, 2).astype("f4"), "out_conv.weight": rng.normal(0, 1, (1, 2, 1, 1)).astype("f4"), "out_conv.bias": rng.normal(0, 1, 1).astype("f4")}
    _checkpoint(held, tmp_path / "best.pt")
    x = rng.random((6, 8))

    def block(planes, name):
        for at in (0, 3):
            w, norm = held[f"{name}.block.{at}.weight"], [held[f"{name}.block.{at + 1}.{p}"][:, None, None] for p in ("weight", "bias", "running_mean", "running_var")]
            wide, (_, h, wd) = np.pad(planes, ((0, 0), (1, 1), (1, 1))), planes.shape
            out = np.array([sum((w[o, c, i, j] * wide[c, i : i + h, j : j + wd] for c in range(len(planes)) for i in range(3) for j in range(3)), np.zeros((h, wd))) for o in range(len(w))])
            planes = np.maximum((out - norm[2]) / np.sqrt(norm[3] + 1e-5) * norm[0] + norm[1], 0)
        return planes

    skip = block(x[None], "enc1")
    deep = block(skip.reshape(2, 3, 2, 4, 2).max(axis=(2, 4)), "bottleneck")
    grown = np.einsum("chw,coij->ohiwj", deep, held["up1.weight"]).reshape(2, 6, 8) + held["up1.bias"][:, None, None]
    last = block(np.concatenate((grown, skip)), "dec1")
    want = 1 / (1 + np.exp(-(np.einsum("c,chw->hw", held["out_conv.weight"][0, :, 0, 0], last) + held["out_conv.bias"][0])))
    got = N.forward(N.load((tmp_path / "best.pt").read_bytes()), x[None, None])
    assert np.allclose(got[0, 0], want, atol=1e-5)
    with zipfile.ZipFile(tmp_path / "bad.pt", "w") as out:
        out.writestr("a/data.pkl", pickle.dumps(os.system))
    with pytest.raises(pickle.UnpicklingError):
        N.load((tmp_path / "bad.pt").read_bytes())
