"""An extension: fitted recodes over streams."""
