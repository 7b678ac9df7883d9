"""Part of obsengine: operators."""
