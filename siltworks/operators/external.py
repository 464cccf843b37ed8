"""Interfaces of inventory rows that need libraries or devices that are not here. Each names what it lacks."""

from __future__ import annotations

from collections.abc import Callable

#: Interface and what it needs.
NEEDS = {
    "decode_video": "a video decoder",
    "embed_images": "an image embedding model; operators take embeddings as a nullable column",
    "optical_flow": "a flow network",
    "perceptual_distance": "a perceptual metric network",
    "render_scene": "a renderer",
    "train_network": "a tensor library and accelerators",
    "export_network": "a tensor library",
    "time_network": "an accelerator",
}


class Unavailable(NotImplementedError):
    """An operator whose library, model or device this installation lacks."""


def external(name: str) -> Callable:
    """A function that raises ``Unavailable`` and says what ``name`` needs."""
    lack = NEEDS[name]

    def refuse(*args, **kwargs):
        raise Unavailable(f"{name} needs {lack}")

    refuse.__name__ = name
    return refuse
