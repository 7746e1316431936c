"""Plans from text: the filter and sort mini-language, SQL text and schemas."""
