"""Where the rows of declared sources come from."""

from .registry import Sources, conformed, read

__all__ = ["Sources", "conformed", "read"]
