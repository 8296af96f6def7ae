"""Readers of the engine's inputs; nothing here touches the network."""
