"""From definitions to checked, lazily lowered plans."""

from .compiler import Compiled, Origin, compile_model
from .project import Project

__all__ = ["Compiled", "Origin", "Project", "compile_model"]
