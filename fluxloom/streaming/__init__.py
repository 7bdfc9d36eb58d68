"""Extensions over streams of observations."""
