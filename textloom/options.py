"""Options of a data preparation run, checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DataOptions:
    dataset: tuple[str, ...] = ()
    eval_dataset: tuple[str, ...] = ()
    cutoff_len: int = 2048
    val_size: float = 0.0
    mix_strategy: str = "concat"
    interleave_probs: tuple[float, ...] = ()
    streaming: bool = False
    max_samples: int | None = None
    train_on_prompt: bool = False
    mask_history: bool = False
    packing: bool = False
    neat_packing: bool = False

    def __post_init__(self):
        checks = (
            (not self.dataset and self.val_size > 1e-6, "val_size needs a dataset"),
            (bool(self.eval_dataset) and self.val_size > 1e-6, "val_size and eval_dataset exclude each other"),
            (bool(self.interleave_probs) and self.mix_strategy == "concat", "interleave_probs needs an interleave strategy"),
            (bool(self.interleave_probs) and len(self.interleave_probs) != len(self.dataset), "interleave_probs needs one value a dataset"),
            (self.streaming and 1e-6 < self.val_size < 1, "streaming needs a whole val_size"),
            (self.streaming and self.max_samples is not None, "streaming has no max_samples"),
            (self.mask_history and self.train_on_prompt, "mask_history and train_on_prompt exclude each other"),
            (self.neat_packing and not self.packing, "neat_packing needs packing"),
            (self.mix_strategy not in ("concat", "interleave_under", "interleave_over", "interleave_once"), "unknown mix_strategy"),
        )
        for bad, why in checks:
            if bad:
                raise ValueError(why)

    @property
    def pack_capacity(self) -> int:
        """One place of the cutoff is kept for padding when packing."""
        return self.cutoff_len - 1 if self.packing else self.cutoff_len
