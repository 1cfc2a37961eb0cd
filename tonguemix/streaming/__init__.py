"""Line-at-a-time detection with Structured Streaming."""
