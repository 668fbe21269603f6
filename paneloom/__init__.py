"""paneloom: panel, event and text analytics expressed as Spark DataFrame plans."""
