"""Programs kept up to date over streams of facts."""

from strataflow.streaming.incremental import Maintained

__all__ = ["Maintained"]
