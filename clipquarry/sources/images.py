"""Uploaded images: checked and decoded by an injected decoder."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from inspect import signature

import numpy as np

LEAST_SIDE = 16


def load(path: str) -> Callable:
    """The object at ``module:attribute``."""
    module, _, name = path.partition(":")
    if not module or not name:
        raise ValueError(f"{path!r} is not module:attribute")
    return getattr(import_module(module), name)


def model_of(encoder: str, device: str = "cpu"):
    """The model that the function at ``module:attribute`` returns; as far as it takes them, it gets device and dtype (float32 on a CPU, float16 elsewhere)."""
    make = load(encoder)
    takes = signature(make).parameters
    offer = {"device": device, "dtype": "float32" if device.startswith("cpu") else "float16"}
    return make(**{k: v for k, v in offer.items() if k in takes})


def decode_image(data: bytes, decoder: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """Height x width x 3, from bytes that must be an image of at least LEAST_SIDE on either side."""
    if not data:
        raise ValueError("the image is empty")
    try:
        image = np.asarray(decoder(data))
    except Exception as error:
        raise ValueError("the image cannot be decoded") from error
    if image.ndim == 2:
        image = np.repeat(image[..., None], 3, axis=2)
    if image.ndim != 3 or image.shape[2] < 3 or min(image.shape[:2]) < LEAST_SIDE:
        raise ValueError(f"an image has three channels and at least {LEAST_SIDE} x {LEAST_SIDE} pixels")
    return image[..., :3]
