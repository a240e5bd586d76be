"""The version, alone so that nothing has to be loaded for it."""

__version__ = "0.1.0"
