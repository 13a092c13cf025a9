"""Dossier: questionnaire and document analytics expressed as Spark jobs."""
