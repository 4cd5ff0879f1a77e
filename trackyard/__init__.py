"""trackyard: collision-event analytics as PySpark DataFrame operators."""
