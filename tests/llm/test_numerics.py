"""The learners against plain versions: FTRL step by step, the network's convolution spelt out, its gradient by differences."""

import math

import numpy as np
from samplewright.llm import quality, secret_scan
from samplewright.llm.secret_scan import BEFORE, CHARS, INSIDE, Network


def plain_ftrl(examples, labels, alpha=1.0, beta=1.0, l1=0.02, l2=0.01, epochs=3, seed=1):
    z, n = {}, {}

    def weight(i):
        a, b, zi = (0.0, 0.0, z.get(i, 0.0)) if i == "bias" else (l1, l2, z.get(i, 0.0))
        if abs(zi) <= a:
            return 0.0
        return -(zi - math.copysign(a, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + b)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for e in rng.permutation(len(examples)):
            x = dict(zip(examples[e][0].tolist(), examples[e][1].tolist(), strict=True)) | {"bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[e]) * v
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_ftrl_step_by_step():
    rng = np.random.default_rng(5)
    examples = []
    for _ in range(60):
        at = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        examples.append((at, rng.random(len(at)) * 3))
    labels = rng.integers(0, 2, 60).tolist()
    model, want = quality.train(examples, labels, l1=1.0), plain_ftrl(examples, labels, l1=1.0)
    got = {int(i): model.weights[i] for i in np.flatnonzero(model.weights)}
    assert abs(model.bias - want.pop("bias")) < 1e-12
    assert set(got) == {i for i, w in want.items() if w} and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    assert any(w == 0 for w in want.values())  # the first-order penalty keeps some weights at nothing


def made_up(n=12, filters=4, seed=2):
    rng = np.random.default_rng(seed)
    width = secret_scan.WINDOW
    x = rng.integers(0, 2 * CHARS, (n, width))
    net = Network(rng.normal(0, 0.3, (Network.WIDTH, 2 * CHARS, filters)), rng.normal(0, 0.3, filters), rng.normal(0, 1, 3 * filters), 0.2)
    return x, net


def plain_logit(net, row):
    one_hot = np.eye(2 * CHARS)[row]
    steps = len(row) - Network.WIDTH + 1
    y = np.zeros((steps, net.shift.shape[0]))
    for t in range(steps):
        for f in range(y.shape[1]):
            y[t, f] = max(0.0, net.shift[f] + sum(one_hot[t + k] @ net.kernel[k][:, f] for k in range(Network.WIDTH)))
    inside = range(BEFORE - 2, BEFORE + INSIDE - 2)
    outer = [t for t in range(steps) if t not in inside]
    pooled = [max(y[t, f] for t in outer) for f in range(y.shape[1])] + [max(y[t, f] for t in inside) for f in range(y.shape[1])]
    pooled += [sum(y[t, f] for t in inside) / INSIDE for f in range(y.shape[1])]
    return float(np.dot(pooled, net.out) + net.bias)


def test_convolution_spelt_out():
    x, net = made_up(4)
    assert np.allclose(net.logits(x), [plain_logit(net, row) for row in x], atol=1e-10)


def test_gradient_by_differences():
    """Adam's first step moves every parameter against the sign of its gradient, by the rate."""
    x, _ = made_up(20)
    y = (np.arange(20) % 3 == 0).astype(int)
    filters, rate, seed = 3, 0.01, 7
    rng = np.random.default_rng(seed)
    start = Network(rng.normal(0, 0.1, (Network.WIDTH, 2 * CHARS, filters)), np.zeros(filters), rng.normal(0, 0.1, 3 * filters), 0.0)
    weight = np.where(y == 1, 20 / (2 * y.sum()), 20 / (2 * (20 - y.sum())))

    def loss(net):
        logit = net.logits(x)
        return float((weight * (np.logaddexp(0, logit) - y * logit)).mean())

    done = secret_scan.learn(x, y, filters=filters, epochs=1, rate=rate, seed=seed)
    checked = 0
    for name in ("kernel", "shift", "out"):
        flat, moved = getattr(start, name).reshape(-1), getattr(done, name).reshape(-1) - getattr(start, name).reshape(-1)
        for i in np.random.default_rng(1).choice(flat.size, min(flat.size, 60), replace=False):
            held, h = flat[i], 1e-5
            flat[i] = held + h
            above = loss(start)
            flat[i] = held - h
            slope = (above - loss(start)) / (2 * h)
            flat[i] = held
            if abs(slope) > 1e-5:
                assert abs(moved[i] + rate * np.sign(slope)) < 1e-4, (name, i, slope, moved[i])
                checked += 1
            elif abs(slope) < 1e-12:
                assert abs(moved[i]) < 1e-9
    assert checked > 30
