"""A small U-Net in NumPy: forward pass, gradients, training step, weights on disk.

Planes are (batch, channels, height, width) of float32 in [0, 1]; height and width divide by 8.
"""

from __future__ import annotations

import io
import pickle
import time
import zipfile
from collections.abc import Callable

import numpy as np

from rasterloom.operators import kernels

WIDTHS = (16, 32, 64, 128)
_EPS = 1e-5
#: Values of a strip of rows with their surroundings.
_STRIP = 1 << 18
Weights = dict[str, np.ndarray]


def _blocks(widths: tuple[int, ...]) -> list[tuple[str, int, int]]:
    down = [(f"down{i}", a, b) for i, (a, b) in enumerate(zip((1, *widths), widths))]
    up = [(f"up{i}", 2 * widths[i], widths[i]) for i in range(len(widths) - 2, -1, -1)]
    return down + up


def initial(seed: int = 0, widths: tuple[int, ...] = WIDTHS) -> Weights:
    rng = np.random.default_rng(seed)

    def draw(*shape: int) -> np.ndarray:
        bound = 1 / np.sqrt(np.prod(shape[1:]))
        return rng.uniform(-bound, bound, shape).astype(np.float32)

    weights: Weights = {}
    for name, a, b in _blocks(widths):
        for i, inward in enumerate((a, b)):
            weights[f"{name}.conv{i}"] = draw(b, inward, 3, 3)
            for part, value in (("scale", 1.0), ("shift", 0.0), ("mean", 0.0), ("var", 1.0)):
                weights[f"{name}.norm{i}.{part}"] = np.full(b, value, dtype=np.float32)
    for i in range(len(widths) - 2, -1, -1):
        weights[f"rise{i}.weight"], weights[f"rise{i}.bias"] = draw(widths[i + 1], widths[i], 2, 2), np.zeros(widths[i], dtype=np.float32)
    weights["head.weight"], weights["head.bias"] = draw(1, widths[0]), np.zeros(1, dtype=np.float32)
    return weights


def parameters(weights: Weights) -> int:
    """Number of trained values: running means and variances are none."""
    return sum(w.size for k, w in weights.items() if not k.endswith((".mean", ".var")))


def save(weights: Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, **weights)
    return out.getvalue()


def load(body: bytes) -> Weights:
    """Weights from an npz archive, of which no objects are unpickled, or from a checkpoint of named tensors."""
    if any(name.endswith("data.pkl") for name in zipfile.ZipFile(io.BytesIO(body)).namelist()):
        return from_tensors(tensors(body))
    with np.load(io.BytesIO(body), allow_pickle=False) as held:
        return {k: held[k] for k in held.files}


#: Storage classes of a checkpoint and their NumPy types.
_STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "LongStorage": "<i8", "IntStorage": "<i4"}


class _Tensors(pickle.Unpickler):
    """Unpickles dictionaries of tensors and nothing else."""

    def __init__(self, archive: zipfile.ZipFile, index: str) -> None:
        super().__init__(io.BytesIO(archive.read(index)))
        self.archive, self.folder = archive, index.removesuffix("data.pkl")

    def find_class(self, module: str, name: str) -> object:
        if (module, name) == ("collections", "OrderedDict"):
            return dict
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _tensor
        if module == "torch" and name in _STORAGES:
            return _STORAGES[name]
        raise pickle.UnpicklingError(f"a checkpoint holds tensors, not {module}.{name}")

    def persistent_load(self, pid: tuple) -> np.ndarray:
        return np.frombuffer(self.archive.read(f"{self.folder}data/{pid[2]}"), dtype=pid[1])


def _tensor(storage: np.ndarray, offset: int, size: tuple[int, ...], stride: tuple[int, ...], *_: object) -> np.ndarray:
    if offset < 0 or any(n < 0 for n in (*size, *stride)) or offset + sum((n - 1) * step for n, step in zip(size, stride)) >= max(len(storage), 1):
        raise pickle.UnpicklingError("a tensor lies outside its storage")
    return np.lib.stride_tricks.as_strided(storage[offset:], size, tuple(storage.itemsize * step for step in stride)).copy()


def tensors(body: bytes) -> dict[str, np.ndarray]:
    """The tensors of a checkpoint file by name, plain or under ``model_state_dict``."""
    with zipfile.ZipFile(io.BytesIO(body)) as archive:
        index = next(name for name in archive.namelist() if name.endswith("data.pkl"))
        held = _Tensors(archive, index).load()
    held = held.get("model_state_dict", held)
    return {k: v for k, v in held.items() if isinstance(v, np.ndarray)}


def from_tensors(held: dict[str, np.ndarray]) -> Weights:
    """Weights from tensors named ``enc1``..., ``bottleneck``, ``up``..., ``dec``... and ``out_conv``.

    There a decoder block sees the grown planes first and the skipped ones behind them, here the
    other way round.
    """
    depth = sum(k.startswith("enc") and k.endswith("block.0.weight") for k in held)
    names = {f"enc{i + 1}": f"down{i}" for i in range(depth)} | {"bottleneck": f"down{depth}"} | {f"dec{i + 1}": f"up{i}" for i in range(depth)}
    weights: Weights = {}
    for theirs, own in names.items():
        for i, at in enumerate((0, 3)):
            weights[f"{own}.conv{i}"] = held[f"{theirs}.block.{at}.weight"]
            for part, name in (("scale", "weight"), ("shift", "bias"), ("mean", "running_mean"), ("var", "running_var")):
                weights[f"{own}.norm{i}.{part}"] = held[f"{theirs}.block.{at + 1}.{name}"]
        if theirs.startswith("dec"):
            first = weights[f"{own}.conv0"]
            grown = held[f"up{theirs[3:]}.weight"].shape[1]
            weights[f"{own}.conv0"] = np.concatenate((first[:, grown:], first[:, :grown]), axis=1)
    for i in range(depth):
        weights[f"rise{i}.weight"], weights[f"rise{i}.bias"] = held[f"up{i + 1}.weight"], held[f"up{i + 1}.bias"]
    weights["head.weight"], weights["head.bias"] = held["out_conv.weight"].reshape(1, -1), held["out_conv.bias"]
    return {k: np.ascontiguousarray(w, dtype=np.float32) for k, w in weights.items()}


def transposed(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Transposed 2 x 2 convolution with stride 2 of ``x(n, c, h, w)``: planes of double size."""
    n, _, h, w = x.shape
    return np.einsum("nchw,coij->nohiwj", x, weight, optimize=True).reshape(n, weight.shape[1], 2 * h, 2 * w) + bias[:, None, None]


class _Tape:
    """Records, in order, how to carry gradients back."""

    def __init__(self, weights: Weights) -> None:
        self.weights = weights
        self.back: list[Callable[[], None]] = []
        self.grads: dict[int, np.ndarray] = {}
        self.wgrads: Weights = {}

    def add(self, x: np.ndarray, grad: np.ndarray) -> None:
        self.grads[id(x)] = self.grads[id(x)] + grad if id(x) in self.grads else grad

    def conv(self, x: np.ndarray, name: str) -> np.ndarray:
        w = self.weights[name]
        n, _, h, wide = x.shape
        padded = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
        flat = w.transpose(0, 2, 3, 1).reshape(len(w), -1)
        out = np.empty((n, w.shape[0], h, wide), dtype=np.float32)
        for k in range(n):  # nine shifted copies of one image's planes, then one product
            spread = np.concatenate([padded[k, :, i : i + h, j : j + wide] for i in range(3) for j in range(3)])
            np.matmul(flat, spread.reshape(len(spread), -1), out=out[k].reshape(len(w), -1))

        def back() -> None:
            grad, gx, gw = self.grads[id(out)], np.zeros_like(padded), np.zeros_like(w)
            for i in range(3):
                for j in range(3):
                    gx[:, :, i : i + h, j : j + wide] += np.einsum("oc,nohw->nchw", w[:, :, i, j], grad, optimize=True)
                    gw[:, :, i, j] = np.einsum("nohw,nchw->oc", grad, padded[:, :, i : i + h, j : j + wide], optimize=True)
            self.add(x, gx[:, :, 1:-1, 1:-1])
            self.wgrads[name] = gw

        self.back.append(back)
        return out

    def norm_relu(self, x: np.ndarray, name: str) -> np.ndarray:
        w = self.weights
        scale, shift = w[f"{name}.scale"], w[f"{name}.shift"]
        mean, var = x.mean(axis=(0, 2, 3)), x.var(axis=(0, 2, 3))
        count = x.size / x.shape[1]
        w[f"{name}.mean"] = 0.9 * w[f"{name}.mean"] + 0.1 * mean
        w[f"{name}.var"] = 0.9 * w[f"{name}.var"] + 0.1 * var * count / max(count - 1, 1)
        spread = 1 / np.sqrt(var + _EPS)
        own = (x - mean[:, None, None]) * spread[:, None, None]
        out = np.maximum(own * scale[:, None, None] + shift[:, None, None], 0).astype(np.float32)

        def back() -> None:
            grad = self.grads[id(out)] * (out > 0)
            self.wgrads[f"{name}.scale"], self.wgrads[f"{name}.shift"] = (grad * own).sum(axis=(0, 2, 3)), grad.sum(axis=(0, 2, 3))
            inner = grad * scale[:, None, None]
            mean_of = lambda a: a.mean(axis=(0, 2, 3), keepdims=True)
            self.add(x, spread[:, None, None] * (inner - mean_of(inner) - own * mean_of(inner * own)))

        self.back.append(back)
        return out

    def block(self, x: np.ndarray, name: str) -> np.ndarray:
        for i in range(2):
            x = self.norm_relu(self.conv(x, f"{name}.conv{i}"), f"{name}.norm{i}")
        return x

    def pool(self, x: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        parts = x.reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
        best = parts.argmax(axis=-1)
        out = np.take_along_axis(parts, best[..., None], axis=-1)[..., 0].copy()

        def back() -> None:
            spread = np.zeros_like(parts)
            np.put_along_axis(spread, best[..., None], self.grads[id(out)][..., None], axis=-1)
            self.add(x, spread.reshape(n, c, h // 2, w // 2, 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(x.shape))

        self.back.append(back)
        return out

    def rise(self, x: np.ndarray, skip: np.ndarray, name: str) -> np.ndarray:
        """Transposed convolution to double size, joined below the skip planes."""
        weight = self.weights[f"{name}.weight"]
        n, _, h, w = x.shape
        grown = transposed(x, weight, self.weights[f"{name}.bias"])
        out = np.concatenate((skip, grown), axis=1).astype(np.float32)

        def back() -> None:
            grad = self.grads[id(out)]
            self.add(skip, grad[:, : skip.shape[1]])
            own = grad[:, skip.shape[1] :].reshape(n, -1, h, 2, w, 2)
            self.add(x, np.einsum("nohiwj,coij->nchw", own, weight, optimize=True))
            self.wgrads[f"{name}.weight"], self.wgrads[f"{name}.bias"] = np.einsum("nchw,nohiwj->coij", x, own, optimize=True), own.sum(axis=(0, 2, 3, 4, 5))

        self.back.append(back)
        return out

    def head(self, x: np.ndarray) -> np.ndarray:
        weight = self.weights["head.weight"]
        out = (1 / (1 + np.exp(-(np.einsum("oc,nchw->nohw", weight, x, optimize=True) + self.weights["head.bias"][:, None, None])))).astype(np.float32)

        def back() -> None:
            grad = self.grads[id(out)] * out * (1 - out)
            self.add(x, np.einsum("oc,nohw->nchw", weight, grad, optimize=True))
            self.wgrads["head.weight"], self.wgrads["head.bias"] = np.einsum("nohw,nchw->oc", grad, x, optimize=True), grad.sum(axis=(0, 2, 3))

        self.back.append(back)
        return out


def _depth(weights: Weights, x: np.ndarray) -> int:
    depth = sum(k.startswith("down") and k.endswith("conv0") for k in weights)
    if x.ndim != 4 or x.shape[1] != 1 or x.shape[2] % (1 << depth - 1) or x.shape[3] % (1 << depth - 1):
        raise ValueError(f"planes of one channel whose sides divide by {1 << depth - 1}, not {x.shape}")
    return depth


def _run(tape: _Tape, x: np.ndarray) -> np.ndarray:
    skips, depth = [], _depth(tape.weights, x)
    for i in range(depth):
        x = tape.block(x, f"down{i}")
        if i < depth - 1:
            skips.append(x)
            x = tape.pool(x)
    for i in range(depth - 2, -1, -1):
        x = tape.block(tape.rise(x, skips[i], f"rise{i}"), f"up{i}")
    return tape.head(x)


def _rimmed(h: int, w: int, c: int) -> np.ndarray:
    return np.zeros((h + 2, w + 2, c), dtype=np.float32)


def _convolve(x: np.ndarray, flat: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """3 x 3 convolution of a plane (height, width, channels) with a rim of zeros, shift, cut at zero; the result has a rim as well.

    The three pixels of a row that a place sees lie in one piece, so a strip of rows is copied in
    long runs and multiplied once, while it is in the cache.
    """
    h, w, c = x.shape[0] - 2, x.shape[1] - 2, x.shape[2]
    out, down, step = _rimmed(h, w, flat.shape[1]), x.strides[0], x.itemsize
    rows = max(1, min(h, _STRIP // (9 * c * w)))
    for y in range(0, h, rows):
        m = min(rows, h - y)
        seen = np.lib.stride_tricks.as_strided(x[y:], (m, w, 3, 3 * c), (down, x.strides[1], down, step))
        made = np.ascontiguousarray(seen).reshape(m * w, 9 * c) @ flat
        made += shift
        np.maximum(made.reshape(m, w, -1), 0, out=out[1 + y : 1 + y + m, 1:-1])
    return out


def _prepared(weights: Weights) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Convolutions as matrices, with the normalisation that follows in their weights and a shift."""
    ready = {}
    for name in (k.removesuffix(".conv0") for k in weights if k.endswith(".conv0")):
        for i in range(2):
            w, norm = weights[f"{name}.conv{i}"], f"{name}.norm{i}"
            factor = weights[f"{norm}.scale"] / np.sqrt(weights[f"{norm}.var"] + _EPS)
            flat = (w * factor[:, None, None, None]).transpose(2, 3, 1, 0).reshape(-1, len(w))
            ready[f"{name}.{i}"] = np.ascontiguousarray(flat, dtype=np.float32), (weights[f"{norm}.shift"] - weights[f"{norm}.mean"] * factor).astype(np.float32)
    return ready


def _one_plane(weights: Weights, ready: dict[str, tuple[np.ndarray, np.ndarray]], depth: int, plane: np.ndarray) -> np.ndarray:
    x = np.pad(plane, 1)[..., None]
    skips = []
    for i in range(depth):
        x = _convolve(_convolve(x, *ready[f"down{i}.0"]), *ready[f"down{i}.1"])
        if i < depth - 1:
            skips.append(x)
            inner = x[1:-1, 1:-1]
            tall = np.maximum(inner[::2], inner[1::2])
            x = _rimmed(tall.shape[0], tall.shape[1] // 2, tall.shape[2])
            np.maximum(tall[:, ::2], tall[:, 1::2], out=x[1:-1, 1:-1])
    for i in range(depth - 2, -1, -1):
        weight, skip = weights[f"rise{i}.weight"], skips[i]
        (h, w), c = (x.shape[0] - 2, x.shape[1] - 2), weight.shape[1]
        grown = np.ascontiguousarray(x[1:-1, 1:-1]).reshape(h * w, -1) @ weight.transpose(0, 2, 3, 1).reshape(len(weight), -1)
        both = _rimmed(2 * h, 2 * w, skip.shape[2] + c)
        both[..., : skip.shape[2]] = skip
        both[1:-1, 1:-1, skip.shape[2] :] = grown.reshape(h, w, 2, 2, c).transpose(0, 2, 1, 3, 4).reshape(2 * h, 2 * w, c) + weights[f"rise{i}.bias"]
        x = _convolve(_convolve(both, *ready[f"up{i}.0"]), *ready[f"up{i}.1"])
    return 1 / (1 + np.exp(-(x[1:-1, 1:-1] @ weights["head.weight"][0] + weights["head.bias"])))


def forward(weights: Weights, planes: np.ndarray) -> np.ndarray:
    """The network with its kept means and variances, plane by plane, channels last."""
    planes, ready = planes.astype(np.float32), _prepared(weights)
    depth = _depth(weights, planes)
    return np.stack([_one_plane(weights, ready, depth, p[0]) for p in planes])[:, None].astype(np.float32) if len(planes) else planes


def loss_step(weights: Weights, dirty: np.ndarray, clean: np.ndarray, alpha: float = 1.0, train: bool = True) -> tuple[float, Weights]:
    """alpha * MSE + (1 - alpha) * (1 - SSIM) of a batch and, in training, the gradient of each weight."""
    if not train:
        return _loss(forward(weights, dirty), clean, alpha)[0], {}
    tape = _Tape(weights)
    out = _run(tape, dirty.astype(np.float32))
    loss, tape.grads[id(out)] = _loss(out, clean, alpha)
    for back in reversed(tape.back):
        back()
    return loss, tape.wgrads


def _loss(out: np.ndarray, clean: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """The loss of a batch and its slope by each value of ``out``."""
    error = out - clean
    loss, slope = alpha * float((error**2).mean()), alpha * 2 * error / error.size
    if alpha < 1:
        for k in range(len(out)):
            same, rise = kernels.ssim_slope(out[k, 0].astype(np.float64), clean[k, 0].astype(np.float64))
            loss += (1 - alpha) * (1 - same) / len(out)
            slope[k, 0] -= (1 - alpha) * rise / len(out)
    return loss, slope.astype(np.float32)


def cosine_rate(rate: float, epoch: int, epochs: int) -> float:
    """Learning rate after ``epoch`` of ``epochs``, falling to a hundredth."""
    return rate / 100 + (rate - rate / 100) * (1 + np.cos(np.pi * epoch / epochs)) / 2


def train(pairs: tuple[np.ndarray, np.ndarray], epochs: int = 2, batch: int = 8, rate: float = 1e-3, seed: int = 42, decay: float = 1e-4, widths: tuple[int, ...] = WIDTHS, alpha: float = 0.7, originals: tuple[np.ndarray, np.ndarray] | None = None, note: Callable[[dict, Weights | None], None] | None = None) -> tuple[Weights, list[dict]]:
    """AdamW with a cosine rate on (dirty, clean) planes; the weights of the best validation loss and a log.

    Nine tenths of the pairs train, in a new order in each epoch; the rest validate, from
    ``originals`` where these are given, which are the same pairs without augmentation; there must
    be one of each. The loss is that of :func:`loss_step`. ``note`` is told each epoch's line of
    the log, with the weights where they are the best so far.
    """
    dirty, clean = pairs
    plain = pairs if originals is None else originals
    order = np.random.default_rng(seed).permutation(len(dirty))
    n = max(1, int(0.9 * len(dirty)))
    if len(dirty) - n < 1:
        raise ValueError("too few pairs to validate on")
    learn, judge = order[:n], order[n:]
    weights, rng = initial(seed, widths), np.random.default_rng(seed + 1)
    first, second, step, log, best, kept = {}, {}, 0, [], np.inf, {}
    for epoch in range(1, epochs + 1):
        losses, now, began = [], cosine_rate(rate, epoch - 1, epochs), time.monotonic()
        mixed = rng.permutation(learn)
        for at in range(0, n, batch):
            own = mixed[at : at + batch]
            loss, grads = loss_step(weights, dirty[own], clean[own], alpha)
            losses.append(loss)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                weights[k] = (weights[k] * (1 - now * decay) - now * move).astype(np.float32)
        held = [loss_step(weights, plain[0][judge[i : i + batch]], plain[1][judge[i : i + batch]], alpha, False)[0] for i in range(0, len(judge), batch)]
        log.append({"epoch": epoch, "train_loss": round(float(np.mean(losses)), 8), "val_loss": round(float(np.mean(held)), 8), "lr": round(float(cosine_rate(rate, epoch, epochs)), 10), "elapsed_s": round(time.monotonic() - began, 1)})
        better = log[-1]["val_loss"] < best
        if better:
            best, kept = log[-1]["val_loss"], {k: w.copy() for k, w in weights.items()}
        if note:
            note(log[-1], kept if better else None)
    return kept, log
