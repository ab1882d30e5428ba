"""Weights of the models that are trained on texts made by rule, stored in the package so that no query trains them.

`python -m lociflow.llm.models` trains them all again and writes them; the tests hold the stored ones against a training run."""

from __future__ import annotations

import os

import numpy as np

HERE = os.path.join(os.path.dirname(os.path.abspath(__file__)), "weights")


def load(name: str) -> dict[str, np.ndarray]:
    with np.load(os.path.join(HERE, f"{name}.npz")) as got:
        return {k: got[k] for k in got.files}


def save(name: str, **arrays: np.ndarray) -> None:
    os.makedirs(HERE, exist_ok=True)
    np.savez_compressed(os.path.join(HERE, f"{name}.npz"), **arrays)


def main() -> None:
    from lociflow.llm import html_text, line_quality, pii

    tagger, trees = pii.trained(), html_text.trained()
    save("pii", **vars(tagger))
    save("html_text", feature=trees.feature, cut=trees.cut, value=trees.value, base=np.float64(trees.base))
    save("line_quality", weights=line_quality.trained())


if __name__ == "__main__":
    main()
