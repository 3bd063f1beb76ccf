"""Scalar column expressions (JVM-side, codegen-friendly)."""
from .columns import *  # noqa: F401,F403
