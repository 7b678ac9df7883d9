"""Part of obsengine: streaming."""
