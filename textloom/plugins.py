"""Named functions of several kinds: readers, converters, batching, rendering, media."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Functions by name, and by hook where a plugin has several. Each kind has a table of its own, so
    equal names of different kinds do not meet; within a kind a second registration is refused."""

    def __init__(self, kind: str):
        self.kind = kind
        self.held: dict[str, dict[str, Callable]] = {}

    def register(self, name: str, hook: str = "") -> Callable[[Callable], Callable]:
        def add(fn: Callable) -> Callable:
            hooks = self.held.setdefault(name, {})
            if hook in hooks:
                raise ValueError(f"{self.kind} {name} {hook} is registered".replace("  ", " "))
            hooks[hook] = fn
            return fn

        return add

    def get(self, name: str, hook: str = "") -> Callable:
        if hook not in self.held.get(name, {}):
            raise ValueError(f"no {self.kind} {name} {hook}; known: {sorted(self.held)}".replace("  ", " "))
        return self.held[name][hook]

    def __contains__(self, name: str) -> bool:
        return name in self.held


LOADERS, BATCHING = Registry("loader"), Registry("batching")

# --- fixed values: the tokens that stand for media in the texts of a media plugin -----------------------------------
MEDIA_TOKENS = {
    "base": {},
    "ernie_vl": {"images": "<|IMAGE_PLACEHOLDER|>", "videos": "<|VIDEO_PLACEHOLDER|>"},
    "gemma3": {"images": "<image_soft_token>"},
    "gemma3n": {"images": "<image_soft_token>", "audios": "<audio_soft_token>"},
    "gemma4": {"images": "<|image|>", "videos": "<|video|>", "audios": "<|audio|>"},
    "glm4v": {"images": "<|image|>", "videos": "<|video|>"},
    "intern_vl": {"images": "<image>", "videos": "<video>"},
    "kimi_vl": {"images": "<|media_pad|>"},
    "lfm2_vl": {"images": "<image>"},
    "llama4": {"images": "<|image|>"},
    "llava": {"images": "<image>"},
    "llava_next": {"images": "<image>"},
    "llava_next_video": {"images": "<image>", "videos": "<video>"},
    "minicpm_v": {"images": "<image>", "videos": "<video>", "audios": "<audio>"},
    "minicpm_v_4_6": {"images": "<image>", "videos": "<video>"},
    "mllama": {"images": "<|image|>"},
    "paligemma": {"images": "<image>"},
    "pixtral": {"images": "[IMG]"},
    "qwen2_audio": {"audios": "<|AUDIO|>"},
    "qwen2_omni": {"images": "<|IMAGE|>", "videos": "<|VIDEO|>", "audios": "<|AUDIO|>"},
    "qwen2_vl": {"images": "<|image_pad|>", "videos": "<|video_pad|>"},
    "qwen3_vl": {"images": "<|image_pad|>", "videos": "<|video_pad|>"},
    "video_llava": {"images": "<image>", "videos": "<video>"},
    "youtu_vl": {"images": "<|image_pad|>", "videos": "<|video_pad|>"},
}


def register_media(name: str, tokens: dict[str, str]) -> None:
    if name in MEDIA_TOKENS:
        raise ValueError(f"media plugin {name} is registered")
    MEDIA_TOKENS[name] = tokens


def media_tokens(name: str) -> dict[str, str]:
    if name not in MEDIA_TOKENS:
        raise ValueError(f"no media plugin {name}")
    return MEDIA_TOKENS[name]
